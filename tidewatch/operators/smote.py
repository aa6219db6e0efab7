"""Synthetic minority rows between a minority row and one of its nearest neighbours.

All minority rows are bases and neighbours; ``neighbours.py`` finds the k nearest of each.
Rows are numbered in hash order. Synthetic rows are numbered too, and a hash of the number
picks the base row, its neighbour and the place between.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.columns import col
from tidewatch.operators.features import row_hash
from tidewatch.operators.ladder import value_ladder
from tidewatch.operators.neighbours import BLOCK, nearest
from tidewatch.session import written

NEIGHBOURS = 5
MIN_ROWS, MIN_CLASS = 6, 2


def _draw(number: Column, salt: str) -> Column:
    """52 bits of an md5 of (number, salt) as a long."""
    return F.conv(F.substring(F.md5(F.concat(number.cast("string"), F.lit("|" + salt))), 1, 13), 16, 10).cast("long")


def class_sizes(train: DataFrame, label: str) -> dict[int, int]:
    """Rows of the classes 0 and 1."""
    return {r[0]: r[1] for r in train.where(col(label).isin(0, 1)).groupBy(col(label).cast("int")).count().collect()}


def positions(rows: DataFrame) -> DataFrame:
    """(pos, row, x): rows of (row, x, h) numbered from 0 by hash, then key; the hashes' ladder spreads the order over tasks."""
    ladder = value_ladder(rows.groupBy(F.lit(0).alias("all"), "h").agg(F.count("*").alias("n")), ["all"], "h", ["n"])
    before = ladder.select("h", (F.col("cum_n") - F.col("n")).alias("before"))
    among = F.row_number().over(Window.partitionBy("h").orderBy("row"))
    return rows.join(before, "h").select((F.col("before") + among - 1).cast("long").alias("pos"), "row", "x")


def synthetic_rows(train: DataFrame, label: str, keys: Sequence[str], features: str, seed: int = 42,
                   neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """As many synthetic rows as the smaller class lacks.

    ``features`` is an array<double>. Returns (synthetic_id, label, features, base,
    neighbour), the last two being structs of the rows' keys. k is
    ``min(neighbours, max(1, class size - 1))``; below 6 rows or 2 minority rows, and
    for classes of equal size, there are none. Rows with a null label or null
    features are no candidates.
    """
    spark = train.sparkSession
    train = train.where(col(features).isNotNull())
    key = F.struct(*[col(k).alias(k) for k in keys])
    out = train.select(F.lit(0).cast("long").alias("synthetic_id"), col(label).alias(label), col(features).cast("array<double>").alias(features),
                       key.alias("base"), key.alias("neighbour"))
    sizes = class_sizes(train, label)
    if len(sizes) < 2 or sum(sizes.values()) < MIN_ROWS or min(sizes.values()) < MIN_CLASS or sizes[0] == sizes[1]:
        return out.limit(0)
    minority = min(sizes, key=sizes.get)
    need = abs(sizes[0] - sizes[1])
    rows = train.where(col(label) == minority)
    numbered = written(rows.select(key.alias("row"), col(features).cast("array<double>").alias("x"), row_hash(keys, seed).alias("h")), "smote-rows")
    sample = written(positions(numbered), "smote-positions")
    n = sizes[minority]
    k = min(neighbours, max(1, n - 1))
    near = nearest(sample, k, block).join(sample, "pos")
    pick = _draw(F.col("id"), f"pick{seed}") % (n * k)
    gap = (_draw(F.col("id"), f"gap{seed}").cast("double") + 0.5) / float(2 ** 52)
    numbered = spark.range(need).select("id", F.floor(pick / k).cast("long").alias("pos"), (pick % k).cast("int").alias("nth"), gap.alias("gap"))
    first = numbered.join(near, "pos").select(
        "id", "gap", F.col("row").alias("base"), F.col("x").alias("a"), F.element_at("neighbours", F.col("nth") + 1).alias("pos"))
    pairs = first.join(sample, "pos")
    between = F.zip_with("a", "x", lambda a, b: a + F.col("gap") * (b - a))
    return pairs.select(F.col("id").alias("synthetic_id"), F.lit(minority).cast(out.schema[label].dataType).alias(label),
                        between.alias(features), "base", F.col("row").alias("neighbour"))


def oversampled(train: DataFrame, label: str, keys: Sequence[str], features: str, seed: int = 42) -> DataFrame:
    """(label, features): the training rows and the synthetic ones, classes of equal size."""
    new = synthetic_rows(train, label, keys, features, seed)
    return train.select(col(label).alias(label), col(features).cast("array<double>").alias(features)).unionByName(new.select(label, features))
