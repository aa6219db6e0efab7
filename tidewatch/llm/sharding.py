"""Weighted rendezvous hashing of record keys over shards (native expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, uniform, written


def rendezvous(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """Struct (draw, shard) of the shard with the smallest draw ``-ln(u) / weight``.

    The draw of a shard depends on the key and that shard alone, so a further
    shard takes rows only into itself, and a shard wins in proportion to its weight.
    """
    return F.array_min(F.array(*[
        F.struct((-F.log(uniform(key, F.lit(first + i))) / F.lit(float(w))).alias("draw"),
                 F.lit(first + i).alias("shard"))
        for i, w in enumerate(weights)]))


def shard_records(docs: DataFrame, weights: Sequence[float] = (1.0,) * 24, new_weight: float = 1.0,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """Put every record into a shard by its key and number it there.

    Returns key, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot (gapless
    from 0 in each shard) and grown_shard (with one more shard of ``new_weight``).

    A null key is a key like any other; a null text has no bytes. Rows of one key
    share a shard; slots are drawn row by row, so that a frequent key is numbered by many tasks. An empty
    table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    best = rendezvous(F.col("_key").cast("string"), weights)
    extra = rendezvous(F.col("_key").cast("string"), [new_weight], first=len(weights))
    blob = F.coalesce(F.col("_text").cast("binary"), F.lit(b""))
    placed = rows.select(
        "_key", (F.length(blob) + 8).cast("long").alias("size"), F.crc32(blob).alias("text_crc32"),
        best.alias("_best"), extra.alias("_extra"),
        uniform(F.col("_key").cast("string"), F.crc32(blob), F.monotonically_increasing_id()).alias("_u"),
    ).select(
        "_key", "size", "text_crc32", "_u", F.col("_best.shard").alias("shard"),
        F.when(F.col("_extra.draw") < F.col("_best.draw"), F.col("_extra.shard"))
        .otherwise(F.col("_best.shard")).alias("grown_shard"))
    placed = written(placed, "shard-rows")
    out = numbered(placed, ["shard"], ["_key", "size", "text_crc32"], "_u", placed.count(), "slot", len(weights))
    return out.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"),
                      F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
                      F.col("grown_shard").cast("int").alias("grown_shard"))
