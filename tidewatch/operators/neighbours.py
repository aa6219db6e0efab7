"""Exact k nearest neighbours of all rows, by pivots and the triangle inequality.

Equal vectors meet as one, with their smallest positions. Every vector belongs to the
cell of its nearest pivot, and cells are cut into blocks by the distance to it. The neighbours
inside a vector's own block bound how far away the rest can be; a block of pivot p is
visited only if some of its distances to p lie within that bound of the vector's own distance
to p. Vectors and blocks meet in groups of bounded size, each of which keeps k a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import written

#: Vectors of a block and requests that meet it at once; pivots, which every task holds.
BLOCK, PIVOTS = 4096, 64
_ROWS = 128
_SAFE = 1e-9  # rounding of distances, relative


def matrix(vectors: list) -> np.ndarray:
    return np.array(vectors, np.float64).reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, summed dimension by dimension in order."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        out += (a[:, d][:, None] - b[:, d]) ** 2
    return out


def best(own: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """(pos, other, square): the k nearest of ``others`` (by position) for each of ``own``, itself left out."""
    order = np.argsort(others)
    others, y = others[order], y[order]
    for at in range(0, len(own), _ROWS):
        far = squares(x[at:at + _ROWS], y)
        far[own[at:at + _ROWS][:, None] == others] = np.inf
        first = np.argsort(far, axis=1, kind="stable")[:, :k]
        near = np.take_along_axis(far, first, axis=1)
        keep = np.isfinite(near)
        pos = np.repeat(own[at:at + _ROWS], keep.sum(axis=1))
        yield pd.DataFrame({"pos": pos, "other": others[first[keep]], "square": near[keep]})


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(pos, x, first): each vector once, with its k + 1 smallest positions. The limit works before the shuffle."""
    number = F.row_number().over(Window.partitionBy("x").orderBy("pos"))
    few = rows.withColumn("number", number).where(F.col("number") <= k + 1)
    return few.groupBy("x").agg(F.sort_array(F.collect_list("pos")).alias("first")).select(F.get("first", F.lit(0)).alias("pos"), "x", "first")


def vector_neighbours(points: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(pos, other, square): the k nearest other vectors of each of (pos, x); ties go to the smaller position."""
    spark = points.sparkSession
    n = points.count()
    chosen = points.orderBy(F.xxhash64("pos"), "pos").limit(pivots).select("x").collect()  # bounded by the parameter
    centres = matrix([r["x"] for r in chosen])
    pieces = max(1, math.ceil(n / block))

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                far = squares(matrix(part["x"].tolist()), centres)
                cell = far.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), r=np.sqrt(far[np.arange(len(part)), cell]))

    placed = points.select("pos", "x").mapInPandas(place, "pos long, x array<double>, cell int, r double")
    placed = written(placed.repartitionByRange(pieces, "cell", "r", "pos").withColumn("block", F.spark_partition_id()), "neighbour-blocks")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, own = matrix(pdf["x"].tolist()), pdf["pos"].to_numpy()
        return pd.concat(best(own, x, own, x, k))

    schema = "pos long, other long, square double"
    near = written(placed.groupBy("cell", "block").applyInPandas(inside, schema), "neighbour-near")
    reach = near.groupBy("pos").agg(F.max("square").alias("square"), F.count("*").alias("n")).select(
        "pos", F.when(F.col("n") >= k, F.sqrt("square")).alias("reach"))
    # one row for a block of vectors
    edges = placed.groupBy("cell", "block").agg(F.min("r").alias("low"), F.max("r").alias("high")).toPandas()

    def visit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells, low, high = edges["cell"].to_numpy(), edges["low"].to_numpy(), edges["high"].to_numpy()
        numbers = edges["block"].to_numpy()
        for pdf in parts:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                to = np.sqrt(squares(matrix(part["x"].tolist()), centres))[:, cells]
                within = part["reach"].fillna(np.inf).to_numpy(np.float64)[:, None]
                slack = _SAFE * (to + high)
                ask = (low - to <= within + slack) & (to - high <= within + slack)
                # the vector's own block is known
                ask &= ~((cells == part["cell"].to_numpy()[:, None]) & (numbers == part["block"].to_numpy()[:, None]))
                i, j = np.nonzero(ask)
                yield pd.DataFrame({"pos": part["pos"].to_numpy()[i], "x": part["x"].to_numpy()[i], "cell": cells[j], "block": numbers[j]})

    asked = (placed.join(reach, "pos", "left").select("pos", "x", "reach", "cell", "block")
             .mapInPandas(visit, "pos long, x array<double>, cell int, block int")
             .withColumn("part", F.pmod(F.xxhash64("pos"), F.lit(pieces)).cast("int")))
    asked = written(asked, "neighbour-asked")
    wanted = asked.select("cell", "block", "part").distinct().toDF("_cell", "_block", "_part")
    others = (placed.join(wanted, (F.col("cell") == F.col("_cell")) & (F.col("block") == F.col("_block")))
              .select("pos", "x", F.col("_cell").alias("cell"), F.col("_block").alias("block"), F.col("_part").alias("part")))

    def beside(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = list(best(q["pos"].to_numpy(), matrix(q["x"].tolist()), c["pos"].to_numpy(), matrix(c["x"].tolist()), k)) if len(q) and len(c) else []
        return pd.concat(found) if found else pd.DataFrame({"pos": [], "other": [], "square": []})

    keys = ["cell", "block", "part"]
    more = asked.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(beside, schema)
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("square", "other"))
    return near.unionByName(more).withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def nearest(rows: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(pos, neighbours): for each row of (pos, x) the positions of the k nearest others (all, if fewer).

    Squared Euclidean distance; ties go to the smaller position. Positions are distinct, vectors
    have one length and no nulls. Equal vectors are neighbours at distance 0. An empty table gives an empty result.
    """
    rows = rows.select("pos", "x")
    points = written(distinct_vectors(rows, k), "neighbour-vectors")
    found = vector_neighbours(points.select("pos", "x"), k, block, pivots)
    names = points.select(F.col("pos").alias("other"), F.col("first").alias("_others"))
    # a vector's list: its own positions, then those of the k nearest vectors; k + 1 are enough of each
    near = (found.join(names, "other").select("pos", F.explode("_others").alias("other"), "square")
            .unionByName(points.select("pos", F.explode("first").alias("other"), F.lit(0.0).alias("square")))
            .groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("square", "other"))).alias("near")))
    by_vector = points.select("pos", "x").withColumnRenamed("pos", "_vector").join(near.withColumnRenamed("pos", "_vector"), "_vector").select("x", "near")
    # a frequent vector is one row on the right: adaptive execution may split its rows on the left
    others = F.filter("near", lambda s: s["other"] != F.col("pos"))
    return rows.join(by_vector, "x").select("pos", F.transform(F.slice(others, 1, k), lambda s: s["other"]).alias("neighbours"))
