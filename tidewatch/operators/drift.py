"""Two-sample drift statistics over DataFrames.

Every test runs for all features at once: the two inputs are tagged with a
side, unpivoted to a long ``(side, feature, value)`` frame and aggregated to
one row per (feature, value). Tests are then groupings over ``feature`` on
those aggregated tables; there is no job per column and no row data reaches
the driver. Per-feature tables (one row per feature: a plan-time bound) are
the only broadcast sides.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.binning import count_at_most
from tidewatch.functions.special import chi2_sf, ks_pvalue
from tidewatch.operators.columns import attach_row, col, is_numeric_type
from tidewatch.operators.ladder import quantiles_linear, value_ladder

# Fixed values of the reference semantics: decision thresholds, the share
# floor and the minimum window for PSI.
P_VALUE_THRESHOLD = 0.05
PSI_THRESHOLD = 0.1
JS_THRESHOLD = 0.1
DRIFT_RATIO_THRESHOLD = 0.3
PSI_MIN_CURRENT = 50
PSI_SHARE_FLOOR = 1e-6
PSI_DEFAULT_BINS = 10
JS_MAX_BINS = 50

TEST_SCHEMA = ("feature string, feature_type string, test string, statistic double, p_value double, "
               "drift_detected boolean, info string")


@dataclass
class DriftReport:
    tests: DataFrame      # one row per (feature, test)
    features: DataFrame   # one row per feature
    summary: DataFrame    # one row


# ---------------------------------------------------------------- long frames

def _sided(reference: DataFrame, current: DataFrame, cols: Sequence[str], cast: str | None) -> DataFrame:
    def proj(df, side):
        exprs = [(col(c).cast(cast) if cast else col(c)).alias(c) for c in cols]
        return df.select(F.lit(side).alias("_side"), *exprs)
    return proj(reference, 0).unionByName(proj(current, 1))


def numeric_counts(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value double, n_ref, n_cur): null and NaN dropped per column."""
    if not cols:
        return reference.sparkSession.createDataFrame([], "feature string, value double, n_ref long, n_cur long")
    long = (_sided(reference, current, cols, "double")
            .unpivot(["_side"], list(cols), "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))
    return long.groupBy("feature", "value").agg(
        F.count_if(F.col("_side") == 0).alias("n_ref"), F.count_if(F.col("_side") == 1).alias("n_cur"))


def category_counts(reference: DataFrame, current: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, category string, n_ref, n_cur): nulls dropped per column."""
    if not cols:
        return reference.sparkSession.createDataFrame([], "feature string, category string, n_ref long, n_cur long")
    long = (_sided(reference, current, cols, "string")
            .unpivot(["_side"], list(cols), "feature", "category")
            .where(F.col("category").isNotNull()))
    return long.groupBy("feature", "category").agg(
        F.count_if(F.col("_side") == 0).alias("n_ref"), F.count_if(F.col("_side") == 1).alias("n_cur"))


# ---------------------------------------------------------------- per-test operators

def ks_from_ladder(ladder: DataFrame, p_value: Callable[[Column, Column, Column], Column] = ks_pvalue) -> DataFrame:
    """(feature, statistic, p_value) from a ladder with n_ref / n_cur weights.

    ``p_value`` is the limiting series, or ``ks_pvalue_auto`` for exact values of small samples."""
    gap = F.abs(F.col("cum_n_ref") / F.col("tot_n_ref") - F.col("cum_n_cur") / F.col("tot_n_cur"))
    per = ladder.groupBy("feature").agg(
        F.max(gap).alias("statistic"), F.first("tot_n_ref").alias("R"), F.first("tot_n_cur").alias("C"))
    return per.select("feature", "statistic", p_value(F.col("statistic"), F.col("R"), F.col("C")).alias("p_value"))


def psi_from_ladder(ladder: DataFrame, num_bins: int = PSI_DEFAULT_BINS,
                    min_current: int = PSI_MIN_CURRENT, floor: float = PSI_SHARE_FLOOR) -> DataFrame:
    """D3: PSI on quantile bins of the reference. Returns (feature, statistic, info).

    Rules in order: an empty side -> null; all pooled values equal -> 0.0;
    fewer than ``min_current`` current values -> null with info; bins =
    min(num_bins, max(4, n_cur // 5)); duplicate edges removed; outer edges
    open; fewer than 2 edges -> 0.0; shares floored at ``floor``.
    """
    stats = ladder.groupBy("feature").agg(
        F.first("tot_n_ref").alias("R"), F.first("tot_n_cur").alias("C"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"))
    k = F.least(F.lit(num_bins), F.greatest(F.lit(4), (F.col("C") / 5).cast("long"))).cast("int")
    eligible = stats.where((F.col("R") > 0) & (F.col("C") >= min_current) & (F.col("vmin") < F.col("vmax")))
    probs = eligible.select(
        "feature", F.col("R").alias("n"),
        F.transform(F.sequence(F.lit(0), k), lambda i: i.cast("double") / k.cast("double")).alias("probs"))
    q = quantiles_linear(ladder, ["feature"], "value", "n_ref", probs)
    edges = q.select("feature", F.array_distinct(F.array_sort("quantiles")).alias("edges"))
    interior = edges.select(
        "feature", F.size("edges").alias("n_edges"),
        F.when(F.size("edges") > 2, F.slice("edges", 2, F.size("edges") - 2))
        .otherwise(F.array().cast("array<double>")).alias("interior"))
    binned = (ladder.join(F.broadcast(interior.where(F.col("n_edges") >= 2)), "feature")
              .withColumn("bin", count_at_most(F.col("interior"), F.col("value"), max(num_bins - 1, 0)))
              .groupBy("feature", "bin")
              .agg(F.sum("n_ref").alias("nr"), F.sum("n_cur").alias("nc"),
                   F.first("tot_n_ref").alias("R"), F.first("tot_n_cur").alias("C")))
    r = F.greatest(F.col("nr") / F.col("R"), F.lit(floor))
    c = F.greatest(F.col("nc") / F.col("C"), F.lit(floor))
    psi_val = binned.groupBy("feature").agg(F.sum((r - c) * F.log(r / c)).alias("psi"))

    out = (stats.join(interior.select("feature", "n_edges"), "feature", "left")
           .join(psi_val, "feature", "left"))
    statistic = (F.when((F.col("R") == 0) | (F.col("C") == 0), F.lit(None).cast("double"))
                 .when(F.col("vmin") == F.col("vmax"), F.lit(0.0))
                 .when(F.col("C") < min_current, F.lit(None).cast("double"))
                 .when(F.col("n_edges") < 2, F.lit(0.0))
                 .otherwise(F.col("psi")))
    info = F.when((F.col("R") > 0) & (F.col("C") > 0) & (F.col("vmin") < F.col("vmax")) & (F.col("C") < min_current),
                  F.lit(f"window too small for PSI (n<{min_current})"))
    return out.select("feature", statistic.alias("statistic"), info.alias("info"))


def categorical_tests(counts: DataFrame, key: str, min_current: int = PSI_MIN_CURRENT,
                      floor: float = PSI_SHARE_FLOOR) -> DataFrame:
    """D2 + D4 from (feature, key, n_ref, n_cur).

    Returns (feature, chi_stat, chi_p, chi_info, cpsi, cpsi_info). Chi-square
    is the 2 x k homogeneity test without continuity correction, null when the
    smallest expected count is below 1. Categorical PSI uses the same share
    floor as PSI and is null below ``min_current`` current rows.
    """
    tot = counts.groupBy("feature").agg(
        F.sum("n_ref").alias("R"), F.sum("n_cur").alias("C"), F.count(F.lit(1)).alias("k"))
    j = counts.join(F.broadcast(tot), "feature")
    s = (F.col("n_ref") + F.col("n_cur")).cast("double")
    total = (F.col("R") + F.col("C")).cast("double")
    e_ref = F.col("R") * s / total
    e_cur = F.col("C") * s / total
    chi_term = (F.pow(F.col("n_ref") - e_ref, 2) / e_ref) + (F.pow(F.col("n_cur") - e_cur, 2) / e_cur)
    r = F.greatest(F.col("n_ref") / F.col("R"), F.lit(floor))
    c = F.greatest(F.col("n_cur") / F.col("C"), F.lit(floor))
    per = j.groupBy("feature").agg(
        F.first("R").alias("R"), F.first("C").alias("C"), F.first("k").alias("k"),
        F.sum(chi_term).alias("chi"), F.min(F.least(e_ref, e_cur)).alias("min_e"),
        F.sum((r - c) * F.log(r / c)).alias("psi"))
    empty = (F.col("R") == 0) | (F.col("C") == 0)
    chi_stat = (F.when(empty | (F.col("min_e") < 1.0), F.lit(None).cast("double"))
                .when(F.col("k") < 2, F.lit(0.0)).otherwise(F.col("chi")))
    chi_p = (F.when(empty | (F.col("min_e") < 1.0), F.lit(None).cast("double"))
             .when(F.col("k") < 2, F.lit(1.0)).otherwise(chi2_sf(F.col("chi"), F.col("k") - 1)))
    chi_info = F.when(~empty & (F.col("min_e") < 1.0),
                      F.format_string("min_expected=%.2f < 1 — sample too small for chi-square", F.col("min_e")))
    cpsi = F.when(F.col("C") < min_current, F.lit(None).cast("double")).otherwise(F.col("psi"))
    cpsi_info = F.when(F.col("C") < min_current, F.lit(f"window too small for categorical_psi (n<{min_current})"))
    return per.select("feature", chi_stat.alias("chi_stat"), chi_p.alias("chi_p"), chi_info.alias("chi_info"),
                      cpsi.alias("cpsi"), cpsi_info.alias("cpsi_info"))


# ---------------------------------------------------------------- feature typing

def infer_feature_types(num_counts: DataFrame, cat_counts: DataFrame) -> DataFrame:
    """(feature, feature_type, reference_n, current_n, numeric_dtype).

    Distinct counts come from the aggregated tables, not from another scan:
    1 distinct reference value -> constant, <= 2 -> binary, numeric type ->
    numeric, else categorical.
    """
    def stats(counts, numeric):
        return counts.groupBy("feature").agg(
            F.count_if(F.col("n_ref") > 0).alias("nd_ref"), F.sum("n_ref").alias("reference_n"),
            F.sum("n_cur").alias("current_n")).withColumn("numeric_dtype", F.lit(numeric))
    s = stats(num_counts, True).unionByName(stats(cat_counts, False))
    ftype = (F.when(F.col("nd_ref") == 1, "constant").when(F.col("nd_ref") <= 2, "binary")
             .when(F.col("numeric_dtype"), "numeric").otherwise("categorical"))
    return s.select("feature", ftype.alias("feature_type"), "reference_n", "current_n", "numeric_dtype")


# ---------------------------------------------------------------- table drift

def data_drift(reference: DataFrame, current: DataFrame, feature_cols: Sequence[str] | None = None,
               feature_types: Mapping[str, str] | None = None, psi_bins: int = PSI_DEFAULT_BINS,
               p_threshold: float = P_VALUE_THRESHOLD, psi_threshold: float = PSI_THRESHOLD,
               ratio_threshold: float = DRIFT_RATIO_THRESHOLD, min_current: int = PSI_MIN_CURRENT,
               buckets: int | None = None,
               ks_p_value: Callable[[Column, Column, Column], Column] = ks_pvalue) -> DriftReport:
    """Drift of every feature of ``current`` against ``reference``.

    numeric -> KS + PSI; binary and categorical -> chi-square + categorical
    PSI; constant -> skipped; an empty side -> error entry. A feature drifted
    if any of its tests fired; the table drifted if drifted / listed features
    > ``ratio_threshold`` (constants and empties stay in the denominator). A
    listed feature missing from a side gets an error entry instead of failing.
    """
    spark = reference.sparkSession
    if feature_cols is None:
        feature_cols = [c for c in reference.columns if c in current.columns]
    feature_cols = list(dict.fromkeys(feature_cols))
    both = [c for c in feature_cols if c in reference.columns and c in current.columns]
    missing = [c for c in feature_cols if c not in both]
    rtypes = {f.name: f.dataType for f in reference.schema.fields}
    num_cols = [c for c in both if is_numeric_type(rtypes[c])]
    cat_cols = [c for c in both if c not in num_cols]

    ncounts = numeric_counts(reference, current, num_cols).persist()
    ccounts = category_counts(reference, current, cat_cols).persist()

    inferred = infer_feature_types(ncounts, ccounts)
    if feature_types:
        given = spark.createDataFrame([(k, v) for k, v in feature_types.items()], "feature string, given_type string")
        inferred = (inferred.join(F.broadcast(given), "feature", "left")
                    .withColumn("feature_type", F.coalesce("given_type", "feature_type")).drop("given_type"))
    listed = spark.createDataFrame([(c, i) for i, c in enumerate(feature_cols)], "feature string, ord int")
    missing_df = spark.createDataFrame([(c,) for c in missing] or [], "feature string")
    features = listed.join(F.broadcast(inferred), "feature", "left")
    features = features.withColumn("reference_n", F.coalesce("reference_n", F.lit(0)).cast("long")) \
                       .withColumn("current_n", F.coalesce("current_n", F.lit(0)).cast("long"))
    is_missing = F.col("feature").isin(missing) if missing else F.lit(False)
    error = (F.when(is_missing, F.lit("missing column"))
             .when((F.col("reference_n") == 0) | (F.col("current_n") == 0), F.lit("empty column")))
    features = features.withColumn("error", error).withColumn(
        "feature_type", F.when(F.col("error").isNotNull(), F.lit(None).cast("string"))
        .otherwise(F.coalesce("feature_type", F.lit("numeric"))))
    features = features.persist()
    ftypes = features.select("feature", "feature_type", "numeric_dtype")

    # numeric family: KS + PSI on the ladder of features typed numeric
    num_typed = ftypes.where(F.col("feature_type") == "numeric").select("feature")
    ladder = value_ladder(ncounts.join(F.broadcast(num_typed), "feature", "left_semi"),
                          ["feature"], "value", ["n_ref", "n_cur"], buckets=buckets).persist()
    ks = ks_from_ladder(ladder, ks_p_value)
    psi = psi_from_ladder(ladder, num_bins=psi_bins, min_current=min_current)
    ks_rows = ks.select("feature", F.lit("ks").alias("test"), "statistic", "p_value",
                        (F.col("p_value") < p_threshold).alias("drift_detected"),
                        F.lit(None).cast("string").alias("info"))
    psi_rows = psi.select("feature", F.lit("psi").alias("test"), "statistic", F.lit(None).cast("double").alias("p_value"),
                          F.coalesce(F.col("statistic") > psi_threshold, F.lit(False)).alias("drift_detected"), "info")

    # categorical family: numeric features typed binary/categorical use the value as category
    cat_typed = ftypes.where(F.col("feature_type").isin("binary", "categorical")).select("feature")
    as_cat = (ncounts.join(F.broadcast(cat_typed), "feature", "left_semi")
              .select("feature", F.col("value").cast("string").alias("category"), "n_ref", "n_cur")
              .unionByName(ccounts.join(F.broadcast(cat_typed), "feature", "left_semi")))
    ct = categorical_tests(as_cat, "category", min_current=min_current).persist()  # feeds two test rows
    chi_rows = ct.select("feature", F.lit("chi_square").alias("test"), F.col("chi_stat").alias("statistic"),
                         F.col("chi_p").alias("p_value"),
                         F.coalesce(F.col("chi_p") < p_threshold, F.lit(False)).alias("drift_detected"),
                         F.col("chi_info").alias("info"))
    cpsi_rows = ct.select("feature", F.lit("categorical_psi").alias("test"), F.col("cpsi").alias("statistic"),
                          F.lit(None).cast("double").alias("p_value"),
                          F.coalesce(F.col("cpsi") > psi_threshold, F.lit(False)).alias("drift_detected"),
                          F.col("cpsi_info").alias("info"))

    tests = (ks_rows.unionByName(psi_rows).unionByName(chi_rows).unionByName(cpsi_rows)
             .join(F.broadcast(ftypes.select("feature", "feature_type")), "feature")
             .where(F.col("feature_type").isin("numeric", "binary", "categorical"))
             .select("feature", "feature_type", "test", "statistic", "p_value", "drift_detected", "info")
             .persist())  # one row per (feature, test); reused by the feature and summary views

    per_feature = tests.groupBy("feature").agg(F.bool_or("drift_detected").alias("_any"),
                                               F.count(F.lit(1)).alias("n_tests"))
    features_out = (features.join(F.broadcast(per_feature), "feature", "left")
                    .select("feature", "ord", "feature_type",
                            F.coalesce("_any", F.lit(False)).alias("drift_detected"),
                            F.coalesce("n_tests", F.lit(0)).cast("long").alias("n_tests"),
                            "reference_n", "current_n", "error",
                            F.when(F.col("feature_type") == "constant", F.lit("constant feature — skipped"))
                            .alias("info")))
    n_features = len(feature_cols)
    summary = features_out.agg(
        F.count_if("drift_detected").alias("drift_count"), F.sum("n_tests").cast("long").alias("total_tests"))
    ratio = (F.col("drift_count") / F.lit(n_features)) if n_features else F.lit(0.0)
    summary = summary.select(
        (ratio > ratio_threshold).alias("data_drift_detected"), ratio.cast("double").alias("drift_ratio"),
        F.lit(n_features).cast("long").alias("n_features"), F.col("drift_count").cast("long").alias("drift_count"),
        F.coalesce("total_tests", F.lit(0)).cast("long").alias("total_tests"))
    return DriftReport(tests=tests, features=features_out, summary=summary)


def nested_report(report: DriftReport) -> DataFrame:
    """One row holding the per-feature test lists as nested structs."""
    per = (report.tests.groupBy("feature")
           .agg(F.array_sort(F.collect_list(F.struct("test", "statistic", "p_value", "drift_detected", "info")))
                .alias("tests")))
    feats = report.features.join(per, "feature", "left")
    nested = feats.agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct("feature_type", "tests", "drift_detected", "reference_n", "current_n", "error", "info"))))
        .alias("per_feature"))
    return attach_row(report.summary, nested)


# ---------------------------------------------------------------- pair tests on one column

def ks_two_sample(reference: DataFrame, current: DataFrame, column: str, buckets: int | None = None,
                  p_value: Callable[[Column, Column, Column], Column] = ks_pvalue) -> DataFrame:
    """D1 on a single column of two frames: (feature, statistic, p_value, drift_detected)."""
    counts = numeric_counts(reference, current, [column])
    out = ks_from_ladder(value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur"], buckets=buckets), p_value)
    return out.withColumn("drift_detected", F.col("p_value") < P_VALUE_THRESHOLD)


def psi_two_sample(reference: DataFrame, current: DataFrame, column: str, num_bins: int = PSI_DEFAULT_BINS,
                   buckets: int | None = None) -> DataFrame:
    counts = numeric_counts(reference, current, [column])
    out = psi_from_ladder(value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur"], buckets=buckets), num_bins)
    return out.withColumn("drift_detected", F.coalesce(F.col("statistic") > PSI_THRESHOLD, F.lit(False)))


def categorical_two_sample(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    counts = category_counts(reference, current, [column])
    return categorical_tests(counts, "category")


# ---------------------------------------------------------------- Jensen-Shannon distance

def js_distance(reference: DataFrame, current: DataFrame, cols: Sequence[str], buckets: int | None = None,
                threshold: float = JS_THRESHOLD) -> DataFrame:
    """Jensen-Shannon distance (natural log) on numpy 'auto' bins of the pooled values.

    Bin width = min(Sturges, Freedman-Diaconis) (Sturges alone when the IQR
    is 0); 0.0 when the reference has fewer than 2 distinct values.
    Returns (feature, statistic, n_bins, drift_detected).
    """
    counts = numeric_counts(reference, current, cols).withColumn("n_all", F.col("n_ref") + F.col("n_cur"))
    ladder = value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur", "n_all"], buckets=buckets).persist()
    stats = ladder.groupBy("feature").agg(
        F.first("tot_n_ref").alias("R"), F.first("tot_n_cur").alias("C"), F.first("tot_n_all").alias("N"),
        F.count_if(F.col("n_ref") > 0).alias("nd_ref"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    q = quantiles_linear(ladder, ["feature"], "value", "n_all",
                         stats.select("feature", F.col("N").alias("n"), F.array(F.lit(0.75), F.lit(0.25)).alias("probs")))
    st = stats.join(q, "feature", "left")
    n = F.col("N").cast("double")
    sturges = (F.col("hi") - F.col("lo")) / (F.log2(n) + 1.0)
    fd = 2.0 * (F.col("quantiles")[0] - F.col("quantiles")[1]) * F.pow(n, -1.0 / 3.0)
    width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    same = F.col("lo") == F.col("hi")
    first = F.when(same, F.col("lo") - 0.5).otherwise(F.col("lo"))
    last = F.when(same, F.col("hi") + 0.5).otherwise(F.col("hi"))
    nb = F.when(width > 0, F.ceil((last - first) / width)).otherwise(F.lit(1)).cast("long")
    geom = st.select("feature", "R", "C", "nd_ref", first.alias("first"), last.alias("last"), nb.alias("nb"))

    step = (F.col("last") - F.col("first")) / F.col("nb")

    def edge(i):
        return F.when(i >= F.col("nb"), F.col("last")).otherwise(i.cast("double") * step + F.col("first"))
    idx0 = ((F.col("value") - F.col("first")) / (F.col("last") - F.col("first")) * F.col("nb")).cast("long")
    idx1 = F.when(idx0 >= F.col("nb"), F.col("nb") - 1).otherwise(idx0)
    binned = ladder.join(F.broadcast(geom), "feature").withColumn("_i", idx1)
    binned = binned.withColumn("_i", F.when(F.col("value") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    binned = binned.withColumn("_i", F.when((F.col("value") >= edge(F.col("_i") + 1)) & (F.col("_i") != F.col("nb") - 1),
                                            F.col("_i") + 1).otherwise(F.col("_i")))
    per_bin = binned.groupBy("feature", "_i").agg(F.sum("n_ref").alias("a"), F.sum("n_cur").alias("b"),
                                                  F.first("R").alias("R"), F.first("C").alias("C"))
    p = F.col("a") / F.col("R")
    qv = F.col("b") / F.col("C")
    m = (p + qv) / 2.0
    rel = (F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(qv > 0, qv * F.log(qv / m)).otherwise(0.0))
    js = per_bin.groupBy("feature").agg(F.sqrt(F.greatest(F.sum(rel), F.lit(0.0)) / 2.0).alias("js"))
    out = geom.join(js, "feature", "left")
    stat = (F.when((F.col("R") == 0) | (F.col("C") == 0), F.lit(None).cast("double"))
            .when(F.least(F.lit(JS_MAX_BINS), F.col("nd_ref")) < 2, F.lit(0.0)).otherwise(F.col("js")))
    return out.select("feature", stat.alias("statistic"), F.col("nb").alias("n_bins"),
                      F.coalesce(stat > threshold, F.lit(False)).alias("drift_detected"))
