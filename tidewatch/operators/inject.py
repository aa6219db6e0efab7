"""Reproducible drift injection and parametric window rows.

Randomness comes from md5 hashes of (row key, column, seed), never from
``rand``/``randn``: the values are the same after a repartition, after an
executor is lost and recomputed, and in another engine.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.normalize import clip_round_flag
from tidewatch.operators.columns import col, is_numeric_type
from tidewatch.operators.ladder import value_ladder

# Column-name prefixes never perturbed (ids, targets, dates).
SKIP_PREFIXES = ("TARGET_", "Sample ID", "STUDY_ID", "CONTACT_NUMBER", "DATE", "INITIALS")
TWO_POW_52 = 4503599627370496.0
# Largest distinct-value table joined by broadcast; larger ones use a shuffle join.


def key_text(keys: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(col(k).cast("string"), F.lit("\\N")) for k in keys])


def uniform(key: Column, salt: str) -> Column:
    """Uniform in (0, 1) from 52 bits of md5(key|salt)."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + salt))), 1, 13), 16, 10).cast("double")
    return (h + 0.5) / TWO_POW_52


def normal(key: Column, salt: str) -> Column:
    """Standard normal by Box-Muller over two hash uniforms."""
    u1 = uniform(key, salt + "|1")
    u2 = uniform(key, salt + "|2")
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * u2)


def _skip(c: str, exclude: Iterable[str]) -> bool:
    return c in set(exclude) or c.startswith(SKIP_PREFIXES)


def gaussian_drift(df: DataFrame, keys: Sequence[str], noise_std: float = 0.5, seed: int = 42,
                   exclude: Iterable[str] = ()) -> DataFrame:
    """G1: add N(0, noise_std) to every numeric column not skipped; those become double."""
    exclude = set(exclude) | set(keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    k = key_text(keys)
    out = []
    for c in df.columns:
        if not _skip(c, exclude) and is_numeric_type(types[c]):
            out.append((col(c).cast("double") + F.lit(noise_std) * normal(k, f"{c}|{seed}")).alias(c))
        else:
            out.append(col(c))
    return df.select(*out)


def _distinct_ranked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, rank 0.., nd) for the distinct non-null values of each column, ranks
    by value order; computed with the range-bucketed ladder, not a global window."""
    long = (df.select(*[col(c).cast("string").alias(c) for c in cols])
            .unpivot([], list(cols), "feature", "value").where(F.col("value").isNotNull())
            .groupBy("feature", "value").agg(F.lit(1).alias("one")))
    lad = value_ladder(long, ["feature"], "value", ["one"])
    return lad.select("feature", "value", (F.col("cum_one") - 1).alias("rank"), F.col("tot_one").alias("nd"))


def category_swap(df: DataFrame, keys: Sequence[str], swap_pct: float = 0.3, seed: int = 42,
                  exclude: Iterable[str] = ()) -> DataFrame:
    """In every text column with >= 2 distinct values, a hash-chosen share
    ``swap_pct`` of the rows gets a value drawn evenly from the column's distinct
    values (it may draw the same value again).

    The draw is a join on (column, rank), left to the planner: AQE broadcasts the
    distinct values only if they are measured small. Rows that keep their value
    carry negative ranks spread by hash, so no null key gathers them in one task.
    """
    exclude = set(exclude) | set(keys)
    types = {f.name: f.dataType for f in df.schema.fields}
    text = [c for c in df.columns if not _skip(c, exclude) and type(types[c]).__name__ == "StringType"]
    if not text:
        return df
    ranked = _distinct_ranked(df, text).where(F.col("nd") >= 2).persist()
    nd = ranked.groupBy("feature").agg(F.first("nd").alias("nd"))
    nd_wide = nd.groupBy().pivot("feature", text).agg(F.first("nd"))
    k = key_text(keys)
    row_id = F.xxhash64(k, F.lit(seed))
    base = df.withColumn("__rid", row_id).withColumn("__k", k)
    from tidewatch.operators.columns import attach_row
    base = attach_row(base, nd_wide.select(*[F.col(f"`{c}`").alias(f"__nd_{i}") for i, c in enumerate(text)]))
    lookup = ranked.select("feature", "rank", F.col("value").alias("new_value"))
    out = base
    for i, c in enumerate(text):
        ndc = F.col(f"__nd_{i}")
        swap = ndc.isNotNull() & (uniform(F.col("__k"), f"{c}|{seed}|swap") < swap_pct)
        pick = (F.floor(uniform(F.col("__k"), f"{c}|{seed}|pick") * ndc)).cast("long")
        out = out.withColumn(f"__r_{i}", F.when(swap, pick).otherwise(-1 - F.pmod(F.col("__rid"), F.lit(1 << 40))))
        lk = lookup.where(F.col("feature") == c).select(F.col("rank").alias(f"__r_{i}"),
                                                        F.col("new_value").alias(f"__v_{i}"))
        out = out.join(lk, f"__r_{i}", "left")
        out = out.withColumn(c, F.when(F.col(f"__r_{i}") >= 0, F.col(f"__v_{i}")).otherwise(col(c)))
        out = out.drop(f"__r_{i}", f"__v_{i}")
    return out.select(*[col(c) for c in df.columns])


def combined_drift(df: DataFrame, keys: Sequence[str], noise_std: float = 1.0, swap_pct: float = 0.4,
                   seed: int = 42, exclude: Iterable[str] = ()) -> DataFrame:
    """Gaussian noise, then a category swap with seed + 1."""
    g = gaussian_drift(df, keys, noise_std, seed, exclude)
    return category_swap(g, keys, swap_pct, seed + 1, exclude)


# ---------------------------------------------------------------- scenarios and curves

# The scenario catalogue (scenario -> feature -> curve) of the
# reference simulator.
SCENARIOS: dict[str, dict[str, str]] = {
    "gradual_age_shift": {"AGE (YEARS)": "linear_up", "BMI": "linear_down", "TEMPERATURE_CELCIUS": "none",
                          "TB_CONTACT": "none", "NUMBER_OF_OCCUPANTS": "none", "BASELINE_POSITIVE": "none",
                          "TARGET_NON_CONVERSION_ANY": "linear_up"},
    "sudden_outbreak": {"HEMOPTYSIS": "step_up_mid", "FEVER": "step_up_mid", "COUGH": "step_up_mid",
                        "TEMPERATURE_CELCIUS": "step_up_mid", "TARGET_NON_CONVERSION_ANY": "step_up_mid"},
    "seasonal_bmi": {"BMI": "sine", "AGE (YEARS)": "none", "TEMPERATURE_CELCIUS": "none",
                     "TARGET_NON_CONVERSION_ANY": "sine"},
    "cohort_composition": {"HIV_STATUS": "linear_up", "BMI": "linear_down", "WEIGHT LOSS": "linear_up",
                           "TARGET_NON_CONVERSION_ANY": "linear_up"},
    "measurement_bias": {"TEMPERATURE_CELCIUS": "step_up_mid", "AGE (YEARS)": "none", "BMI": "none", "COUGH": "none",
                         "FEVER": "none", "TARGET_NON_CONVERSION_ANY": "none"},
    "adversarial": {"TARGET_NON_CONVERSION_ANY": "step_up_mid", "AGE (YEARS)": "none", "BMI": "none", "FEVER": "none",
                    "COUGH": "none", "HEMOPTYSIS": "none"},
    "mixed": {"AGE (YEARS)": "linear_up", "BMI": "sine", "HIV_STATUS": "linear_up", "TEMPERATURE_CELCIUS": "none",
              "TARGET_NON_CONVERSION_ANY": "linear_up"},
}
# Curve shapes as (factor of the reference mean) at progress t.
CURVE_LINEAR_UP = 0.4
CURVE_LINEAR_DOWN = -0.3
CURVE_STEP = 0.25
CURVE_SINE = 0.15
FLAG_COLUMNS = ("BASELINE_POSITIVE", "TARGET_NON_CONVERSION_ANY", "TARGET_NON_CONVERSION_2M", "TARGET_NON_CONVERSION_5M",
                "IS_IMPUTED", "TARGET_STRICT_M2", "M2_DISCORDANT", "TARGET_SYMPTOM_PRESENT")
COUNT_COLUMNS = ("TB_CONTACT", "NUMBER_OF_OCCUPANTS")


def scenario_table(spark) -> DataFrame:
    """The catalogue as a lookup table (scenario, feature, curve)."""
    rows = [(s, f, c) for s, m in SCENARIOS.items() for f, c in m.items()]
    return spark.createDataFrame(rows, "scenario string, feature string, curve string")


def curve_delta(curve: Column, t: Column, step_at: float = 0.5) -> Column:
    """Drift of the mean as a factor of the reference mean at progress t."""
    return (F.when(curve == "linear_up", CURVE_LINEAR_UP * t)
            .when(curve == "linear_down", CURVE_LINEAR_DOWN * t)
            .when(curve == "step_up_mid", F.when(t >= step_at, F.lit(CURVE_STEP)).otherwise(0.0))
            .when(curve == "step_down_mid", F.when(t >= step_at, F.lit(-CURVE_STEP)).otherwise(0.0))
            .when(curve == "sine", CURVE_SINE * F.sin(t * 4 * math.pi))
            .otherwise(F.lit(0.0)))


def drift_parameters(numeric_profile: DataFrame, scenario: str, total_windows: int, step_at: float = 0.5) -> DataFrame:
    """(window, feature, mean, std) for every window 0..total-1 and every numeric
    profile feature the scenario drifts (curve not 'none'). Categorical features keep
    their reference distribution (the reference's curves leave them unchanged)."""
    spark = numeric_profile.sparkSession
    curves = scenario_table(spark).where((F.col("scenario") == scenario) & (F.col("curve") != "none"))
    prof = numeric_profile.join(F.broadcast(curves), "feature", "inner")  # one row per feature
    windows = prof.select("*", F.explode(F.sequence(F.lit(0), F.lit(total_windows - 1))).alias("window"))
    t = F.col("window").cast("double") / float(total_windows)
    return windows.select("window", "feature", "curve",
                          (F.col("mean") + F.col("mean") * curve_delta(F.col("curve"), t, step_at)).alias("mean"),
                          F.col("std"))


def bootstrap(values: DataFrame, column: str, order_key: str, n: int, seed: int = 42) -> DataFrame:
    """N draws with replacement from the non-null values of a column.

    Rows get dense ranks by ``order_key`` from the ladder (no global window);
    each draw picks a rank by hash and joins on it.
    """
    src = values.where(col(column).isNotNull()).select(col(order_key).alias("_k"), col(column).alias("value"))
    lad = value_ladder(src.withColumn("_g", F.lit(0)).withColumn("_w", F.lit(1)), ["_g"], "_k", ["_w"])
    ranked = lad.select((F.col("cum__w") - 1).alias("rank"), "value", F.col("tot__w").alias("N"))
    total = ranked.agg(F.max("N").alias("N"))
    draws = values.sparkSession.range(n).withColumnRenamed("id", "draw")
    from tidewatch.operators.columns import attach_row
    draws = attach_row(draws, total).withColumn(
        "rank", F.floor(uniform(F.col("draw").cast("string"), f"boot|{column}|{seed}") * F.col("N")).cast("long"))
    return draws.join(ranked.drop("N"), "rank", "inner").select("draw", "value")


def generate_windows(numeric_profile: DataFrame, categorical_profile: DataFrame, params: DataFrame | None,
                     n_windows: int, n_records: int = 10, seed: int = 42) -> DataFrame:
    """Parametric window rows in long form (window, record, feature, num_value, cat_value).

    Numeric: N(mean, std) clipped to [min, max] with the window's parameters
    (reference mean and std when the feature is not drifted); flag columns are
    rounded and clipped to 0/1, count columns to [min, max]. Categorical:
    drawn by cumulative share. All draws are hash uniforms of (window, record,
    feature, seed). The categorical profile is held per feature as one array,
    so it is meant for the bounded-cardinality features a window is built from
    (the reference profiles clinical flags and codes).
    """
    spark = numeric_profile.sparkSession
    recs = spark.range(n_windows * n_records).select(
        (F.col("id") / n_records).cast("int").alias("window"), (F.col("id") % n_records).cast("int").alias("record"))
    key = F.concat_ws("|", F.col("window").cast("string"), F.col("record").cast("string"), F.col("feature"))

    num_feats = numeric_profile.select("feature", "mean", "std", "min", "max")
    # one row holding the per-feature parameters (bounded by the number of features)
    num_list = num_feats.select(F.collect_list(F.struct("feature", "mean", "std", "min", "max")).alias("_f"))
    from tidewatch.operators.columns import attach_row
    num = attach_row(recs, num_list).select("window", "record", F.explode("_f").alias("p")).select(
        "window", "record", "p.*")
    if params is not None:
        num = (num.join(params.select("window", "feature", F.col("mean").alias("_pm"), F.col("std").alias("_ps")),
                        ["window", "feature"], "left")
               .withColumn("mean", F.coalesce("_pm", "mean")).withColumn("std", F.coalesce("_ps", "std")))
    z = normal(key, f"gen|{seed}")
    v = F.least(F.greatest(F.col("mean") + F.col("std") * z, F.col("min")), F.col("max"))
    v = (F.when(F.col("feature").isin(list(FLAG_COLUMNS)), clip_round_flag(v).cast("double"))
         .when(F.col("feature").isin(list(COUNT_COLUMNS)), F.least(F.greatest(F.rint(v), F.col("min")), F.col("max")))
         .otherwise(v))
    num_rows = num.select("window", "record", "feature", v.alias("num_value"), F.lit(None).cast("string").alias("cat_value"))

    cats = categorical_profile.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("category", "share"))).alias("_d"))
    cats = cats.select("feature", F.transform("_d", lambda e, i: F.struct(
        e["category"].alias("category"),
        F.aggregate(F.slice("_d", 1, i + 1), F.lit(0.0), lambda acc, x: acc + x["share"]).alias("cum"))).alias("_cum"))
    cat_list = cats.select(F.collect_list(F.struct("feature", "_cum")).alias("_f"))
    cat = attach_row(recs, cat_list).select("window", "record", F.explode("_f").alias("p")).select(
        "window", "record", "p.feature", "p._cum")
    u = uniform(key, f"cat|{seed}")
    chosen = F.coalesce(F.filter("_cum", lambda e: u < e["cum"])[0]["category"], F.element_at("_cum", -1)["category"])
    cat_rows = cat.select("window", "record", "feature", F.lit(None).cast("double").alias("num_value"),
                          chosen.alias("cat_value"))
    return num_rows.unionByName(cat_rows)


def correlate_on(long_rows: DataFrame, trigger: str, targets: Mapping[str, float], shares: Mapping[str, float],
                 seed: int = 42) -> DataFrame:
    """Where ``trigger`` is YES in a (window, record), each target feature is set
    to NO unless u <= min(1, share(target) * multiplier)."""
    trig = (long_rows.where((F.col("feature") == trigger) & (F.col("cat_value") == "YES"))
            .select("window", "record", F.lit(True).alias("_trig")))
    j = long_rows.join(trig, ["window", "record"], "left")
    key = F.concat_ws("|", F.col("window").cast("string"), F.col("record").cast("string"), F.col("feature"))
    u = uniform(key, f"corr|{seed}")
    cond = F.lit(False)
    for feat, mult in targets.items():
        p = min(1.0, shares.get(feat, 0.2) * mult)
        cond = cond | ((F.col("feature") == feat) & (u > p))
    return j.withColumn("cat_value", F.when(F.coalesce("_trig", F.lit(False)) & cond, F.lit("NO"))
                        .otherwise(F.col("cat_value"))).drop("_trig")
