"""Mergeable profiles (A1, A14, A15): one row of moments and sketches per window and column.

A window is profiled once and its row is kept; profiles of longer spans are merged from
rows, so the data aren't read again. Counts, minimum, maximum, mean and deviation are
exact. Quantiles come from KLL sketches and distinct counts from HyperLogLog sketches,
both Spark's own aggregates (partial on the map side, a few KB a group); the exact
profile is ``profile.numeric_profile``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.columns import col, numeric_columns

KLL_K = 800   # of the quantile sketch
HLL_LG_K = 12  # log2 of the distinct sketch's registers


def rank_bound(k: int = KLL_K) -> float:
    """Bound of a quantile's rank error: twice the published 99 % error of a KLL sketch."""
    return 2 * 2.296 / k ** 0.9021


def distinct_bound(lg_k: int = HLL_LG_K) -> float:
    """Bound of a distinct count's relative error: four standard errors of a merged HyperLogLog sketch."""
    return 4 * 1.04 / 2 ** (lg_k / 2)


def sketch_profile(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), k: int = KLL_K,
                   lg_k: int = HLL_LG_K) -> DataFrame:
    """(by..., feature, n, mean, m2, min, max, quantiles, distincts): a mergeable row per window and numeric column.

    m2 is the sum of squared deviations. Nulls and NaN are left out; a column without
    other values in a window has no row there, and an empty table has none. -0.0 is 0.0.
    """
    cols = [c for c in numeric_columns(df, cols) if c not in by]
    long = (df.select(*map(col, by), *[(col(c).cast("double") + F.lit(0.0)).alias(c) for c in cols])
            .unpivot([col(b) for b in by], [col(c) for c in cols], "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    return long.groupBy(*map(col, by), "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), (F.var_pop("value") * F.count(F.lit(1))).alias("m2"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.kll_sketch_agg_double("value", F.lit(k)).alias("quantiles"),
        F.hll_sketch_agg(F.xxhash64("value"), lg_k).alias("distincts"))


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Profiles of the wider groups ``by`` from rows of ``sketch_profile``, of one or more tables united.

    Deviations are added around the merged mean, which is found first, so no squares of
    large values cancel.
    """
    keys = [*by, "feature"]
    mean = profiles.groupBy(F.struct(*map(col, keys)).alias("_group")).agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("_mean"))
    rows = profiles.withColumn("_key", F.struct(*map(col, keys))).join(mean, F.col("_key").eqNullSafe(F.col("_group")))
    return rows.groupBy(*map(col, keys)).agg(
        F.sum("n").alias("n"), F.first("_mean").alias("mean"),
        F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))).alias("m2"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distincts").alias("distincts"))


def read_profile(profiles: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The profile that the rows hold: other columns, n, mean, std (of a sample), min, max, n_distinct, q (an array, one for each of ``probs``)."""
    others = [c for c in profiles.columns if c not in ("n", "mean", "m2", "min", "max", "quantiles", "distincts")]
    return profiles.select(
        *map(col, others), "n", "mean", F.sqrt(F.try_divide(F.col("m2"), F.col("n") - 1)).alias("std"), "min", "max",
        F.hll_sketch_estimate("distincts").alias("n_distinct"),
        F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for p in probs]).alias("q"))
