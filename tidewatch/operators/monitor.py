"""Windowed drift monitoring against a static reference (T1-T11, D9 by window).

Every current row is assigned to an event-time window; all tests run for all
(window, feature) pairs in the same jobs. The reference is never copied per
window:

* KS: the supremum of |F - G_w| over an interval between two consecutive
  window points is reached at its ends, so D_w only needs the reference ECDF
  F at the window's own points (F(x) and F(x-)), looked up in the prepared
  reference (``reference.py``).
* PSI: the bin count depends on the window size (k = min(bins, max(4,
  n // 5))), so reference edges are computed once per (feature, k), at most
  seven sets per feature, and broadcast.
* Chi-square and categorical PSI: categories missing from a window contribute
  in closed form (sum over absent categories = C / R * (R - present mass) for
  chi-square), so only the window's own categories are touched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.binning import count_at_most
from tidewatch.functions.special import chi2_sf, ks_pvalue
from tidewatch.operators import drift as D
from tidewatch.operators.columns import col, is_numeric_type
from tidewatch.operators.ladder import value_ladder
from tidewatch.operators.reference import MIN_BINS, Reference, bin_counts, bin_probs, interior_edges, lookup, prepare
from tidewatch.session import written

WKEY = "window_start"


@dataclass
class WindowReport:
    tests: DataFrame     # (window_start, feature, feature_type, test, statistic, p_value, drift_detected, info)
    windows: DataFrame   # (window_start, n_records, drift_ratio, drift_count, n_features, drift_detected)


def assign_window(df: DataFrame, time_col: str, duration: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding, with ``slide``) event-time windows; adds ``window_start``."""
    ts = col(time_col).cast("timestamp")
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    return df.withColumn(WKEY, w.start)


def _long_num(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return (df.select(*keys, *[col(c).cast("double").alias(c) for c in cols])
            .unpivot(list(keys), list(cols), "feature", "value")
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def _long_cat(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    return (df.select(*keys, *[col(c).cast("string").alias(c) for c in cols])
            .unpivot(list(keys), list(cols), "feature", "category")
            .where(F.col("category").isNotNull()))


def windowed_ks(reference: Reference, cur_counts: DataFrame, buckets: int | None = None,
                p_value: Callable[[Column, Column, Column], Column] = ks_pvalue) -> DataFrame:
    """(window_start, feature, statistic, p_value) from (window_start, feature, value, n_cur);
    ``p_value`` as in ``ks_from_ladder``."""
    fl = lookup(reference, cur_counts.select("feature", "value").distinct())
    gl = value_ladder(cur_counts, [WKEY, "feature"], "value", ["n_cur"], buckets=buckets)
    j = gl.join(fl, ["feature", "value"], "inner")
    g_in = F.col("cum_n_cur") / F.col("tot_n_cur")
    g_ex = (F.col("cum_n_cur") - F.col("n_cur")) / F.col("tot_n_cur")
    d = F.greatest(F.abs(F.col("F_in") - g_in), F.abs(F.col("F_ex") - g_ex))
    per = j.groupBy(WKEY, "feature").agg(F.max(d).alias("statistic"), F.first("R").alias("R"),
                                         F.first("tot_n_cur").alias("C"))
    return per.select(WKEY, "feature", "statistic", p_value(F.col("statistic"), F.col("R"), F.col("C")).alias("p_value"))


def windowed_psi(ref_counts: DataFrame, cur_counts: DataFrame, num_bins: int = D.PSI_DEFAULT_BINS,
                 min_current: int = D.PSI_MIN_CURRENT, floor: float = D.PSI_SHARE_FLOOR,
                 buckets: int | None = None, key: str = "window_start") -> DataFrame:
    """(key, feature, statistic, info): D3 per window with the reference
    edges chosen by the window's own bin count, from (feature, value, n_ref)."""
    rstats = ref_counts.groupBy("feature").agg(F.sum("n_ref").alias("R"), F.min("value").alias("rmin"),
                                               F.max("value").alias("rmax"))
    needed = (window_sizes(rstats, cur_counts, num_bins, key).where((F.col("C") >= min_current) & ~F.col("same"))
              .select("feature", "k").distinct())
    ladder = value_ladder(ref_counts, ["feature"], "value", ["n_ref"], buckets=buckets)
    interior = interior_edges(ladder, bin_probs(needed.join(F.broadcast(rstats), "feature")))
    return psi_of_windows(rstats, interior, bin_counts(ref_counts, interior, num_bins), cur_counts, num_bins, min_current, floor, key)


def window_sizes(rstats: DataFrame, cur_counts: DataFrame, num_bins: int, key: str) -> DataFrame:
    """(key, feature, C, cmin, cmax, R, rmin, rmax, k, same): counts, ranges and the bin count of each window."""
    wstats = cur_counts.groupBy(key, "feature").agg(F.sum("n_cur").alias("C"), F.min("value").alias("cmin"),
                                                    F.max("value").alias("cmax"))
    ws = wstats.join(F.broadcast(rstats), "feature", "inner")  # one row per feature
    k = F.least(F.lit(num_bins), F.greatest(F.lit(MIN_BINS), (F.col("C") / 5).cast("long"))).cast("int")
    return ws.withColumn("k", k).withColumn("same", F.least("rmin", "cmin") == F.greatest("rmax", "cmax"))


def psi_of_windows(rstats: DataFrame, interior: DataFrame, ref_bins: DataFrame, cur_counts: DataFrame, num_bins: int = D.PSI_DEFAULT_BINS,
                   min_current: int = D.PSI_MIN_CURRENT, floor: float = D.PSI_SHARE_FLOOR, key: str = "window_start") -> DataFrame:
    """(key, feature, statistic, info) against a reference's edges and counts for each bin count."""
    WKEY = key  # noqa: N806
    ws = window_sizes(rstats, cur_counts, num_bins, key)
    inter = F.broadcast(interior.where(F.col("n_edges") >= 2))  # features x at most 7 rows
    bin_of = count_at_most(F.col("interior"), F.col("value"), max(num_bins - 1, 0))
    wk = ws.select(WKEY, "feature", "k")
    cur_bins = (cur_counts.join(wk, [WKEY, "feature"]).join(inter, ["feature", "k"]).withColumn("bin", bin_of)
                .groupBy(WKEY, "feature", "bin").agg(F.sum("n_cur").alias("nc")))
    ref_per_window = wk.join(ref_bins, ["feature", "k"]).select(WKEY, "feature", "bin", "nr")
    bins = ref_per_window.join(cur_bins, [WKEY, "feature", "bin"], "full_outer")
    bins = bins.join(ws.select(WKEY, "feature", "R", "C"), [WKEY, "feature"])
    r = F.greatest(F.coalesce("nr", F.lit(0)) / F.col("R"), F.lit(floor))
    c = F.greatest(F.coalesce("nc", F.lit(0)) / F.col("C"), F.lit(floor))
    psi_v = bins.groupBy(WKEY, "feature").agg(F.sum((r - c) * F.log(r / c)).alias("psi"))
    out = ws.join(inter.select("feature", "k", "n_edges"), ["feature", "k"], "left").join(psi_v, [WKEY, "feature"], "left")
    stat = (F.when((F.col("R") == 0) | (F.col("C") == 0), F.lit(None).cast("double"))
            .when(F.col("same"), F.lit(0.0))
            .when(F.col("C") < min_current, F.lit(None).cast("double"))
            .when(F.col("n_edges").isNull() | (F.col("n_edges") < 2), F.lit(0.0))
            .otherwise(F.col("psi")))
    info = F.when(~F.col("same") & (F.col("C") < min_current), F.lit(f"window too small for PSI (n<{min_current})"))
    return out.select(WKEY, "feature", stat.alias("statistic"), info.alias("info"))


def windowed_categorical(reference: Reference, cur_counts: DataFrame, min_current: int = D.PSI_MIN_CURRENT,
                         floor: float = D.PSI_SHARE_FLOOR) -> DataFrame:
    """(window_start, feature, chi_stat, chi_p, chi_info, cpsi, cpsi_info) from (window_start, feature, category, n_cur)."""
    r_share = F.greatest(F.col("n_ref") / F.col("R"), F.lit(floor))
    absent_psi_term = (r_share - floor) * F.log(r_share / floor)
    rtot, levels, s_all = reference.cat_stats, reference.levels, reference.s_all
    cur = cur_counts.join(reference.cats, ["feature", "category"], "left").join(F.broadcast(rtot), "feature")
    cur = cur.withColumn("n_ref", F.coalesce("n_ref", F.lit(0)).cast("long"))
    ctot = cur.groupBy(WKEY, "feature").agg(F.sum("n_cur").alias("C"))
    cur = cur.join(ctot, [WKEY, "feature"])
    total = (F.col("R") + F.col("C")).cast("double")
    s = (F.col("n_ref") + F.col("n_cur")).cast("double")
    e_ref = F.col("R") * s / total
    e_cur = F.col("C") * s / total
    chi_term = F.pow(F.col("n_ref") - e_ref, 2) / e_ref + F.pow(F.col("n_cur") - e_cur, 2) / e_cur
    c_share = F.greatest(F.col("n_cur") / F.col("C"), F.lit(floor))
    present_psi = (r_share - c_share) * F.log(r_share / c_share)
    # leading run of levels whose categories are all present: its length is the rank of the
    # level of the smallest reference category missing from the window
    wp = Window.partitionBy(WKEY, "feature").orderBy("rank")
    complete = (cur.where(F.col("n_ref") > 0).groupBy(WKEY, "feature", "n_ref").agg(F.count(F.lit(1)).alias("have"))
                .join(levels, ["feature", "n_ref"]).where(F.col("have") == F.col("n_cats")))
    gaps = (complete.withColumn("_i", F.row_number().over(wp) - 1)
            .groupBy(WKEY, "feature").agg(F.count_if(F.col("rank") == F.col("_i")).alias("gap")))
    agg = cur.groupBy(WKEY, "feature").agg(
        F.first("R").alias("R"), F.first("C").alias("C"), F.first("ref_k").alias("ref_k"),
        F.sum(chi_term).alias("chi_present"), F.sum(F.when(F.col("n_ref") > 0, F.col("n_ref"))).alias("ref_mass"),
        F.count(F.lit(1)).alias("n_present"), F.count_if(F.col("n_ref") > 0).alias("n_shared"),
        F.min(s).alias("min_s_present"),
        F.sum(present_psi).alias("psi_present"),
        F.sum(F.when(F.col("n_ref") > 0, absent_psi_term)).alias("psi_absent_removed"))
    gap_ref = levels.select("feature", F.col("rank").alias("gap"), F.col("n_ref").alias("gap_n_ref"))
    agg = (agg.join(gaps, [WKEY, "feature"], "left").withColumn("gap", F.coalesce("gap", F.lit(0)))
           .join(gap_ref, ["feature", "gap"], "left").join(F.broadcast(s_all), "feature"))
    R, C = F.col("R"), F.col("C")
    chi = F.col("chi_present") + C / R * (R - F.coalesce(F.col("ref_mass"), F.lit(0)))
    k = F.col("n_present") + F.col("ref_k") - F.col("n_shared")
    min_s = F.least(F.col("min_s_present"), F.coalesce(F.col("gap_n_ref").cast("double"), F.col("min_s_present")))
    min_e = min_s * F.least(R, C) / (R + C)
    empty = (R == 0) | (C == 0)
    chi_stat = F.when(empty | (min_e < 1.0), F.lit(None).cast("double")).when(k < 2, F.lit(0.0)).otherwise(chi)
    chi_p = F.when(empty | (min_e < 1.0), F.lit(None).cast("double")).when(k < 2, F.lit(1.0)).otherwise(chi2_sf(chi, k - 1))
    chi_info = F.when(~empty & (min_e < 1.0),
                      F.format_string("min_expected=%.2f < 1 — sample too small for chi-square", min_e))
    psi = F.col("psi_present") + F.col("S_all") - F.coalesce(F.col("psi_absent_removed"), F.lit(0.0))
    cpsi = F.when(C < min_current, F.lit(None).cast("double")).otherwise(psi)
    cpsi_info = F.when(C < min_current, F.lit(f"window too small for categorical_psi (n<{min_current})"))
    return agg.select(WKEY, "feature", chi_stat.alias("chi_stat"), chi_p.alias("chi_p"), chi_info.alias("chi_info"),
                      cpsi.alias("cpsi"), cpsi_info.alias("cpsi_info"))


def reference_counts(reference: DataFrame, feature_cols: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Aggregated reference: (feature, value, n_ref) for numeric and (feature, category, n_ref)
    for other columns, plus the two column lists. Computed once per reference."""
    types = {f.name: f.dataType for f in reference.schema.fields}
    num = [c for c in feature_cols if is_numeric_type(types[c])]
    cat = [c for c in feature_cols if c not in num]
    spark = reference.sparkSession
    rnum = (_long_num(reference, num, []).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n_ref")) if num
            else spark.createDataFrame([], "feature string, value double, n_ref long"))
    rcat = (_long_cat(reference, cat, []).groupBy("feature", "category").agg(F.count(F.lit(1)).alias("n_ref")) if cat
            else spark.createDataFrame([], "feature string, category string, n_ref long"))
    return rnum, rcat, num, cat


def current_counts(windowed: DataFrame, num: Sequence[str], cat: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(window_start, feature, value, n_cur) and (window_start, feature, category, n_cur)."""
    spark = windowed.sparkSession
    cnum = (_long_num(windowed, num, [WKEY]).groupBy(WKEY, "feature", "value").agg(F.count(F.lit(1)).alias("n_cur")) if num
            else spark.createDataFrame([], f"{WKEY} timestamp, feature string, value double, n_cur long"))
    ccat = (_long_cat(windowed, cat, [WKEY]).groupBy(WKEY, "feature", "category").agg(F.count(F.lit(1)).alias("n_cur")) if cat
            else spark.createDataFrame([], f"{WKEY} timestamp, feature string, category string, n_cur long"))
    return cnum, ccat


def window_tests(reference: Reference, cnum: DataFrame, ccat: DataFrame,
                 psi_bins: int = D.PSI_DEFAULT_BINS, p_threshold: float = D.P_VALUE_THRESHOLD,
                 psi_threshold: float = D.PSI_THRESHOLD, min_current: int = D.PSI_MIN_CURRENT,
                 buckets: int | None = None,
                 ks_p_value: Callable[[Column, Column, Column], Column] = ks_pvalue) -> DataFrame:
    """T2 tests from aggregated counts: one row per (window, feature, test)."""
    types_df = F.broadcast(reference.types)  # one row per feature
    cnum_typed = cnum.join(types_df.where("feature_type = 'numeric'"), "feature", "left_semi")
    ks = windowed_ks(reference, cnum_typed, buckets, ks_p_value)
    psi = psi_of_windows(reference.stats, reference.interior, reference.bins, cnum_typed, psi_bins, min_current)
    bin_cat = types_df.where(F.col("feature_type").isin("binary", "categorical"))
    cur_cat = (cnum.join(bin_cat, "feature", "left_semi")
               .select(WKEY, "feature", F.col("value").cast("string").alias("category"), "n_cur")
               .unionByName(ccat.join(bin_cat, "feature", "left_semi")))
    ct = windowed_categorical(reference, cur_cat, min_current)
    both = F.array(
        F.struct(F.lit("chi_square").alias("test"), F.col("chi_stat").alias("statistic"), F.col("chi_p").alias("p_value"),
                 F.coalesce(F.col("chi_p") < p_threshold, F.lit(False)).alias("drift_detected"), F.col("chi_info").alias("info")),
        F.struct(F.lit("categorical_psi").alias("test"), F.col("cpsi").alias("statistic"), F.lit(None).cast("double").alias("p_value"),
                 F.coalesce(F.col("cpsi") > psi_threshold, F.lit(False)).alias("drift_detected"), F.col("cpsi_info").alias("info")))
    rows = (ks.select(WKEY, "feature", F.lit("ks").alias("test"), "statistic", "p_value",
                      (F.col("p_value") < p_threshold).alias("drift_detected"), F.lit(None).cast("string").alias("info"))
            .unionByName(psi.select(WKEY, "feature", F.lit("psi").alias("test"), "statistic",
                                    F.lit(None).cast("double").alias("p_value"),
                                    F.coalesce(F.col("statistic") > psi_threshold, F.lit(False)).alias("drift_detected"), "info"))
            .unionByName(ct.select(WKEY, "feature", F.inline(both))))
    return rows.join(types_df, "feature").select(WKEY, "feature", "feature_type", "test", "statistic", "p_value",
                                                 "drift_detected", "info")


def window_verdicts(tests: DataFrame, records: DataFrame, n_features: int,
                    ratio_threshold: float = D.DRIFT_RATIO_THRESHOLD) -> DataFrame:
    """T2 verdict per window from its tests and its record count (window_start, n_records)."""
    per_feature = tests.groupBy(WKEY, "feature").agg(F.bool_or("drift_detected").alias("d"))
    drifted = per_feature.groupBy(WKEY).agg(F.count_if("d").alias("drift_count"))
    windows = records.join(drifted, WKEY, "left").select(
        WKEY, "n_records", F.coalesce("drift_count", F.lit(0)).cast("long").alias("drift_count"),
        F.lit(n_features).cast("long").alias("n_features"))
    ratio = F.col("drift_count") / F.lit(max(n_features, 1))
    return windows.withColumn("drift_ratio", ratio.cast("double")).withColumn("drift_detected", ratio > ratio_threshold)


def windowed_data_drift(reference: DataFrame, current: DataFrame, time_col: str, feature_cols: Sequence[str],
                        duration: str = "1 hour", psi_bins: int = D.PSI_DEFAULT_BINS,
                        p_threshold: float = D.P_VALUE_THRESHOLD, psi_threshold: float = D.PSI_THRESHOLD,
                        ratio_threshold: float = D.DRIFT_RATIO_THRESHOLD, min_current: int = D.PSI_MIN_CURRENT,
                        buckets: int | None = None, windowed: DataFrame | None = None,
                        ks_p_value: Callable[[Column, Column, Column], Column] = ks_pvalue) -> WindowReport:
    """T1 + T2: D7 for every window of ``current`` against the whole ``reference``.

    Feature types come from the reference (D6). ``windowed`` may pass a frame
    that already carries ``window_start``.
    """
    feature_cols = [c for c in feature_cols if c in reference.columns and c in current.columns]
    cur = windowed if windowed is not None else assign_window(current, time_col, duration)
    rnum, rcat, num, cat = reference_counts(reference, feature_cols)
    cnum, ccat = (written(c, "window-counts") for c in current_counts(cur, num, cat))
    prepared = prepare(rnum, rcat, psi_bins, D.PSI_SHARE_FLOOR, buckets)
    tests = written(window_tests(prepared, cnum, ccat, psi_bins, p_threshold, psi_threshold, min_current, buckets, ks_p_value), "window-tests")
    records = cur.groupBy(WKEY).agg(F.count(F.lit(1)).alias("n_records"))
    return WindowReport(tests=tests, windows=window_verdicts(tests, records, len(feature_cols), ratio_threshold))


# ---------------------------------------------------------------- window-result tables (small: one row per window)

def window_flags(results: DataFrame, data_col: str = "drift_detected", model_col: str = "model_drift_detected") -> DataFrame:
    """T4 + T9: alert flag and the alert class of each window (data only / model only / both / none)."""
    d = F.coalesce(col(data_col), F.lit(False))
    m = F.coalesce(col(model_col), F.lit(False))
    cls = F.when(d & m, "both").when(d, "data_only").when(m, "model_only").otherwise("none")
    return results.withColumn("alert", d | m).withColumn("alert_class", cls)


def sustained_drift(results: DataFrame, order_col: str = WKEY, data_col: str = "drift_detected",
                    model_col: str = "model_drift_detected", span: int = 6, needed: int = 4) -> DataFrame:
    """T5: at least ``span`` windows seen and >= ``needed`` of the last ``span`` fired (data or model).

    A global ordered window, allowed here because the input holds one row per window.
    """
    w = Window.orderBy(order_col).rowsBetween(-(span - 1), 0)
    wn = Window.orderBy(order_col)
    d = F.coalesce(col(data_col), F.lit(False)).cast("int")
    m = F.coalesce(col(model_col), F.lit(False)).cast("int")
    seen = F.row_number().over(wn)
    return results.withColumn("sustained", (seen >= span) & ((F.sum(d).over(w) >= needed) | (F.sum(m).over(w) >= needed)))


def run_summary(results: DataFrame, order_col: str = WKEY, data_col: str = "drift_detected",
                model_col: str = "model_drift_detected", records_col: str = "n_records") -> DataFrame:
    """Alert counts, max ratio, max AUC drop (null as 0), first alert window, total records."""
    d = F.coalesce(col(data_col), F.lit(False))
    m = F.coalesce(col(model_col), F.lit(False)) if model_col in results.columns else F.lit(False)
    drop = F.coalesce(col("auc_drop"), F.lit(0.0)) if "auc_drop" in results.columns else F.lit(0.0)
    return results.agg(
        F.count(F.lit(1)).alias("windows"), F.count_if(d | m).alias("total_alerts"), F.count_if(d).alias("data_drift_windows"),
        F.count_if(m).alias("model_drift_windows"), F.coalesce(F.max("drift_ratio"), F.lit(0.0)).alias("max_drift_ratio"),
        F.coalesce(F.max(drop), F.lit(0.0)).alias("max_auc_drop"), F.min(F.when(d | m, col(order_col))).alias("first_alert"),
        F.sum(col(records_col)).alias("total_records"))


def bounded_history(results: DataFrame, value_col: str, order_col: str = WKEY, keep: int = 10) -> DataFrame:
    """The last ``keep`` values up to each window (one row per window)."""
    w = Window.orderBy(order_col).rowsBetween(-(keep - 1), 0)
    return results.withColumn(f"{value_col}_history", F.collect_list(col(value_col)).over(w))


def alert_runs(results: DataFrame, flag_col: str, index_col: str) -> DataFrame:
    """Runs of consecutive flagged windows (gaps and islands): (run_start, run_end, length)."""
    f = results.where(F.coalesce(col(flag_col), F.lit(False)))
    g = f.withColumn("_grp", col(index_col) - F.row_number().over(Window.orderBy(index_col)))
    return g.groupBy("_grp").agg(F.min(index_col).alias("run_start"), F.max(index_col).alias("run_end"),
                                 F.count(F.lit(1)).alias("length")).drop("_grp")


def feature_matrix(tests: DataFrame) -> DataFrame:
    """Feature x window drift flags in long form (window_start, feature, drift_detected)."""
    return tests.groupBy(WKEY, "feature").agg(F.bool_or("drift_detected").alias("drift_detected"))


def ratio_series(results: DataFrame) -> DataFrame:
    """(window, drift ratio, AUC drop with null as 0)."""
    drop = F.coalesce(col("auc_drop"), F.lit(0.0)) if "auc_drop" in results.columns else F.lit(0.0)
    return results.select(WKEY, "drift_ratio", drop.alias("auc_drop"))
