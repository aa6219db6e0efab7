"""Reference distributions prepared once, for windows and micro-batches to look up.

The distinct values of a numeric feature and their running counts are written in
blocks of at most BLOCK values, one row a block. A value is looked up by two binary
searches: among the blocks' lowest values (one array a feature, 8 bytes for BLOCK distinct
values) and, after an equi-join on the block, among its values. So the reference
is sorted when it is prepared and never again, however many batches ask. Edges of all bin
counts that PSI may choose, the reference's counts in those bins, and the sums that
categorical tests need of absent categories are prepared likewise.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.binning import count_at_most
from tidewatch.operators.ladder import quantiles_linear, value_ladder
from tidewatch.session import written

BLOCK = 4096
MIN_BINS = 4


@dataclass
class Reference:
    """Tables in the shared folder; ``block_bits`` are the steps of the search among a feature's blocks."""

    types: DataFrame     # (feature, feature_type)
    stats: DataFrame     # (feature, R, rmin, rmax) of numeric features
    blocks: DataFrame    # (feature, block, values, upto, before)
    lows: DataFrame      # (feature, lows)
    block_bits: int
    interior: DataFrame  # (feature, k, n_edges, interior): PSI edges for k bins
    bins: DataFrame      # (feature, k, bin, nr)
    cats: DataFrame      # (feature, category, n_ref), numeric features with two values included
    cat_stats: DataFrame  # (feature, R, ref_k)
    levels: DataFrame    # (feature, n_ref, n_cats, rank)
    s_all: DataFrame     # (feature, S_all)


def feature_types(rnum: DataFrame, rcat: DataFrame) -> DataFrame:
    """D6 on the reference: one row per feature."""
    nd = (rnum.groupBy("feature").agg(F.count(F.lit(1)).alias("nd"), F.lit(True).alias("numeric"))
          .unionByName(rcat.groupBy("feature").agg(F.count(F.lit(1)).alias("nd"), F.lit(False).alias("numeric"))))
    kind = (F.when(F.col("nd") == 1, "constant").when(F.col("nd") <= 2, "binary")
            .when(F.col("numeric"), "numeric").otherwise("categorical"))
    return nd.select("feature", kind.alias("feature_type"))


def interior_edges(ladder: DataFrame, probs: DataFrame) -> DataFrame:
    """(feature, k, n_edges, interior): the distinct quantile edges, and those between the outer two.

    ``probs`` has (feature, k, n, probs): one row for each bin count."""
    q = quantiles_linear(ladder, ["feature"], "value", "n_ref", probs, extra=["k"])
    edges = q.select("feature", "k", F.array_distinct(F.array_sort("quantiles")).alias("edges"))
    return edges.select("feature", "k", F.size("edges").alias("n_edges"),
                        F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2))
                        .otherwise(F.array().cast("array<double>")).alias("interior"))


def bin_probs(stats: DataFrame) -> DataFrame:
    """(feature, k, n, probs) from (feature, k, R)."""
    return stats.select("feature", "k", F.col("R").alias("n"),
                        F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: i.cast("double") / F.col("k").cast("double")).alias("probs"))


def bin_counts(counts: DataFrame, interior: DataFrame, num_bins: int) -> DataFrame:
    """(feature, k, bin, nr): the reference's counts between its edges. ``interior`` has few rows a feature."""
    inner = F.broadcast(interior.where(F.col("n_edges") >= 2))
    return (counts.join(inner, "feature").withColumn("bin", count_at_most(F.col("interior"), F.col("value"), max(num_bins - 1, 0)))
            .groupBy("feature", "k", "bin").agg(F.sum("n_ref").alias("nr")))


def category_sums(cats: DataFrame, floor: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(feature, R, ref_k), (feature, n_ref, n_cats, rank) and (feature, S_all) of (feature, category, n_ref)."""
    r_share = F.greatest(F.col("n_ref") / F.col("R"), F.lit(floor))
    stats = cats.groupBy("feature").agg(F.sum("n_ref").alias("R"), F.count(F.lit(1)).alias("ref_k"))
    # categories with the same count form a level; a column of N rows has at most sqrt(2 N)
    # levels, so ranking them is small however many categories there are
    by_count = Window.partitionBy("feature").orderBy("n_ref")
    levels = (cats.groupBy("feature", "n_ref").agg(F.count(F.lit(1)).alias("n_cats"))
              .withColumn("rank", F.row_number().over(by_count) - 1))
    s_all = cats.join(F.broadcast(stats), "feature").groupBy("feature").agg(F.sum((r_share - floor) * F.log(r_share / floor)).alias("S_all"))
    return stats, levels, s_all


def prepare(rnum: DataFrame, rcat: DataFrame, num_bins: int, floor: float, buckets: int | None = None, block: int = BLOCK) -> Reference:
    """Write all that tests need of a reference: (feature, value, n_ref) and (feature, category, n_ref)."""
    rnum, rcat = written(rnum, "reference-values"), written(rcat, "reference-categories")
    types = written(feature_types(rnum, rcat), "reference-types")
    small = F.broadcast(types)  # one row a feature
    num = rnum.join(small.where("feature_type = 'numeric'"), "feature", "left_semi")
    two = small.where("feature_type in ('binary', 'categorical')")
    cats = written(rnum.join(two, "feature", "left_semi").select("feature", F.col("value").cast("string").alias("category"), "n_ref")
                   .unionByName(rcat.join(two, "feature", "left_semi")), "reference-cats")

    ladder = written(value_ladder(num.withColumn("one", F.lit(1).cast("long")), ["feature"], "value", ["n_ref", "one"], buckets=buckets), "reference-ladder")
    stats = written(ladder.groupBy("feature").agg(F.first("tot_n_ref").alias("R"), F.min("value").alias("rmin"), F.max("value").alias("rmax")),
                    "reference-stats")
    own = F.sort_array(F.collect_list(F.struct("value", F.col("cum_n_ref").alias("upto"))))
    blocks = (ladder.withColumn("block", F.floor((F.col("cum_one") - 1) / block).cast("int"))
              .groupBy("feature", "block").agg(own.alias("own"), F.min(F.col("cum_n_ref") - F.col("n_ref")).alias("before"))
              .select("feature", "block", F.col("own.value").alias("values"), F.col("own.upto").alias("upto"), "before"))
    blocks = written(blocks, "reference-blocks")
    lows = written(blocks.groupBy("feature").agg(F.sort_array(F.collect_list(F.get("values", F.lit(0)))).alias("lows")), "reference-lows")
    most = lows.agg(F.max(F.size("lows")).alias("n")).first()["n"] or 1
    probs = bin_probs(stats.withColumn("k", F.explode(F.sequence(F.lit(MIN_BINS), F.lit(max(MIN_BINS, num_bins))))))
    interior = written(interior_edges(ladder, probs), "reference-edges")
    bins = written(bin_counts(ladder.select("feature", "value", "n_ref"), interior, num_bins), "reference-bins")
    cat_stats, levels, s_all = (written(t, f"reference-{n}") for n, t in zip(("cat-stats", "levels", "shares"), category_sums(cats, floor), strict=True))
    return Reference(types, stats, blocks, lows, int(most).bit_length(), interior, bins, cats, cat_stats, levels, s_all)


def at_most(df: DataFrame, array: str, value: str, bits: int, out: str) -> DataFrame:
    """Add ``out``: how many elements of a sorted array of fewer than 2^bits are at most ``value``."""
    df = df.withColumn(out, F.lit(0))
    for step in (1 << i for i in reversed(range(bits))):
        # beyond the array get() is null, and the search stays
        df = df.withColumn(out, F.col(out) + F.when(F.get(array, F.col(out) + (step - 1)) <= F.col(value), step).otherwise(0))
    return df


def lookup(reference: Reference, points: DataFrame, block: int = BLOCK) -> DataFrame:
    """(feature, value, F_in, F_ex, R): parts of the reference at most and below each of (feature, value).

    Points of features that are not numeric have no rows.
    """
    p = points.join(F.broadcast(reference.lows), "feature")
    p = at_most(p, "lows", "value", reference.block_bits, "_n").select("feature", "value", (F.col("_n") - 1).alias("block"))
    p = p.join(reference.blocks, ["feature", "block"], "left")  # below the lowest value there is no block
    p = at_most(p, "values", "value", block.bit_length(), "_i")
    here = F.get("values", F.col("_i") - 1) == F.col("value")
    upto = F.coalesce(F.get("upto", F.when(F.col("_i") > 0, F.col("_i") - 1)), F.lit(0))
    below = F.when(here, F.when(F.col("_i") > 1, F.get("upto", F.greatest(F.col("_i") - 2, F.lit(0)))).otherwise(F.col("before"))).otherwise(upto)
    p = p.select("feature", "value", upto.alias("_upto"), F.coalesce(below, F.lit(0)).alias("_below"))
    return p.join(F.broadcast(reference.stats.select("feature", "R")), "feature").select(
        "feature", "value", (F.col("_upto") / F.col("R")).alias("F_in"), (F.col("_below") / F.col("R")).alias("F_ex"), "R")
