"""Windowed monitoring queries over ``events`` (T1-T11, D9-D13 by window).

Reference: the first ten days of January 2024; current: the following days in
daily windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import model_drift as MD
from tidewatch.operators import monitor as T
from tidewatch.operators.scoring import logistic_score
from tidewatch.plans import oracle_sql as O
from tidewatch.plans.catalog import register
from tidewatch.plans.drift_plans import _oracle
from tidewatch.sources.tables import read_table

R6 = 6
CUT = "2024-01-11"
FEATURES = ["value", "k", "event_type"]
WFMT = "yyyy-MM-dd HH:mm:ss"


def events_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value",
                     F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


def split(spark, sf_dir):
    ev = events_features(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


_REPORTS: dict = {}


def window_report(spark: SparkSession, sf_dir: str) -> T.WindowReport:
    ref, cur = split(spark, sf_dir)
    return T.windowed_data_drift(ref, cur, "ts", FEATURES, duration="1 day")


BASE_SQL = f"""SELECT ts, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events"""
WIN_SRC = f"""WITH base AS ({BASE_SQL}),
cur AS (SELECT *, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS w FROM base WHERE ts >= TIMESTAMP '{CUT}'),
wins AS (SELECT DISTINCT w FROM cur)
SELECT 0 AS side, wins.w, b.value, b.k, b.event_type FROM base b, wins WHERE b.ts < TIMESTAMP '{CUT}'
UNION ALL SELECT 1, w, value, k, event_type FROM cur"""

WINDOW_TESTS_SQL = f"""
WITH t AS ({_oracle(WIN_SRC, {'value': 'value', 'k': 'k'}, {'event_type': 'event_type'}, fkey="w || '#' || ")})
SELECT split_part(feature, '#', 1) AS window_start, split_part(feature, '#', 2) AS feature, feature_type, test,
       statistic, p_value, drift_detected, info FROM t"""


def _fmt(df: DataFrame) -> DataFrame:
    return df.withColumn(T.WKEY, F.date_format(T.WKEY, WFMT))


@register("window_drift_events", WINDOW_TESTS_SQL, ("T1", "T2", "J4"))
def window_drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = window_report(spark, sf_dir).tests
    return _fmt(t.select(T.WKEY, "feature", "feature_type", "test", F.round("statistic", R6).alias("statistic"),
                         F.round("p_value", R6).alias("p_value"), "drift_detected", "info"))


WINDOWS_SQL = f"""
WITH t AS ({WINDOW_TESTS_SQL}),
f AS (SELECT window_start, feature, bool_or(drift_detected) AS d FROM t GROUP BY ALL),
c AS (SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_records
      FROM ({BASE_SQL}) WHERE ts >= TIMESTAMP '{CUT}' GROUP BY ALL),
w AS (SELECT c.window_start, c.n_records, coalesce(count_if(f.d), 0)::BIGINT AS drift_count
      FROM c LEFT JOIN f USING (window_start) GROUP BY ALL)
SELECT window_start, n_records, drift_count, 3::BIGINT AS n_features, round(drift_count / 3.0, 6) AS drift_ratio,
       drift_count / 3.0 > 0.3 AS drift_detected FROM w"""


def _windows(spark, sf_dir) -> DataFrame:
    return window_report(spark, sf_dir).windows.withColumn("drift_ratio", F.round("drift_ratio", R6))


@register("window_verdicts_events", WINDOWS_SQL, ("T2", "D7"))
def window_verdicts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fmt(_windows(spark, sf_dir))


# ---------------------------------------------------------------- model drift per window

SCORE_W = {"value": 0.01, "k": 0.005}
SCORE_B = -0.5
SCORED_SQL = f"""SELECT ts, (event_type = 'purchase')::INTEGER AS label,
  round(1.0 / (1.0 + exp(-({SCORE_B} + 0.01 * value + 0.005 * k))), 12) AS probability FROM ({BASE_SQL})"""


def scored_events(spark, sf_dir) -> DataFrame:
    ev = events_features(spark, sf_dir).withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return logistic_score(ev, SCORE_W, SCORE_B, digits=12)


MODEL_SQL = f"""
WITH s AS (SELECT *, (probability >= 0.5)::INTEGER AS prediction FROM ({SCORED_SQL})),
ref AS (SELECT * FROM s WHERE ts < TIMESTAMP '{CUT}'),
cur AS (SELECT *, strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS w FROM s WHERE ts >= TIMESTAMP '{CUT}'),
rc AS (SELECT probability AS score, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg FROM ref GROUP BY ALL),
rl AS (SELECT *, sum(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM rc),
rm AS (SELECT sum(n_pos) AS NP, sum(n_neg) AS NN, sum(n_neg * (cp - n_pos + n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) AS auc,
              sum(CASE WHEN n_pos > 0 THEN n_pos * (cp / (cp + cn)) END) / sum(n_pos) AS ap FROM rl),
ra AS (SELECT count(*) AS n, avg((label = prediction)::DOUBLE) AS acc FROM ref),
cc AS (SELECT w, probability AS score, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg FROM cur GROUP BY ALL),
cl AS (SELECT *, sum(n_pos) OVER (PARTITION BY w ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
              sum(n_neg) OVER (PARTITION BY w ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM cc),
cm AS (SELECT w, CASE WHEN sum(n_pos) > 0 AND sum(n_neg) > 0 THEN sum(n_neg * (cp - n_pos + n_pos / 2.0)) / (sum(n_pos) * sum(n_neg)) END AS auc,
              CASE WHEN sum(n_pos) > 0 AND sum(n_neg) > 0 THEN sum(CASE WHEN n_pos > 0 THEN n_pos * (cp / (cp + cn)) END) / sum(n_pos) END AS ap FROM cl GROUP BY w),
ca AS (SELECT w, count(*) AS n, avg((label = prediction)::DOUBLE) AS acc FROM cur GROUP BY w),
src AS (SELECT 0 AS side, wins.w, r.probability FROM ref r, (SELECT DISTINCT w FROM cur) wins UNION ALL SELECT 1, w, probability FROM cur),
nl AS (SELECT side, w || '#prediction_score' AS feature, probability AS v FROM src),
{O.num_counts('nl', 'nc')}, {O.ladder('nc', 'lad')}, {O.psi('nl', 'lad', 'ps')},
p AS (SELECT split_part(feature, '#', 1) AS w, statistic AS psi FROM ps)
SELECT ca.w AS window_start, ca.n AS current_n, round(ca.acc, 6) AS current_accuracy, round(cm.auc, 6) AS current_auc,
  round(cm.ap, 6) AS current_avg_precision, ra.n AS reference_n, round(ra.acc, 6) AS reference_accuracy,
  round(rm.auc, 6) AS reference_auc, round(rm.ap, 6) AS reference_avg_precision, round(p.psi, 6) AS prediction_psi,
  round(rm.auc - cm.auc, 6) AS auc_drop, coalesce(rm.auc - cm.auc > 0.05, false) AS performance_drift,
  coalesce(p.psi > 0.1, false) AS prediction_drift,
  coalesce(rm.auc - cm.auc > 0.05, false) OR coalesce(p.psi > 0.1, false) AS model_drift_detected
FROM ca JOIN cm USING (w) LEFT JOIN p USING (w), ra, rm"""


def window_model(spark, sf_dir) -> DataFrame:
    s = scored_events(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp")
    ref = s.where(F.col("ts") < cut)
    cur = T.assign_window(s.where(F.col("ts") >= cut), "ts", "1 day")
    return MD.model_drift(ref, cur, "label", groups=[T.WKEY])


@register("window_model_drift_events", MODEL_SQL, ("T3", "D9", "D10", "D11", "E9"))
def window_model_drift_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = window_model(spark, sf_dir)
    cols = ["current_accuracy", "current_auc", "current_avg_precision", "reference_accuracy", "reference_auc",
            "reference_avg_precision", "prediction_psi", "auc_drop"]
    m = m.select(T.WKEY, "current_n", "reference_n", *[F.round(c, R6).alias(c) for c in cols],
                 "performance_drift", "prediction_drift", "model_drift_detected")
    return _fmt(m)


# ---------------------------------------------------------------- per-window result tables

RESULTS_SQL = f"""
WITH v AS ({WINDOWS_SQL}), m AS ({MODEL_SQL})
SELECT v.*, m.auc_drop, m.model_drift_detected FROM v LEFT JOIN m USING (window_start)"""


def results_table(spark, sf_dir) -> DataFrame:
    v = _windows(spark, sf_dir)
    m = window_model(spark, sf_dir).select(T.WKEY, F.round("auc_drop", R6).alias("auc_drop"), "model_drift_detected")
    return v.join(m, T.WKEY, "left")


@register("window_alerts_events", f"""
WITH r AS ({RESULTS_SQL}),
f AS (SELECT *, coalesce(drift_detected, false) OR coalesce(model_drift_detected, false) AS alert,
        CASE WHEN coalesce(drift_detected, false) AND coalesce(model_drift_detected, false) THEN 'both'
             WHEN coalesce(drift_detected, false) THEN 'data_only' WHEN coalesce(model_drift_detected, false) THEN 'model_only'
             ELSE 'none' END AS alert_class FROM r)
SELECT window_start, alert, alert_class,
  (row_number() OVER (ORDER BY window_start) >= 6) AND (
    sum(coalesce(drift_detected, false)::INTEGER) OVER (ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 4 OR
    sum(coalesce(model_drift_detected, false)::INTEGER) OVER (ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 4) AS sustained
FROM f""", ("T4", "T5", "T9"))
def window_alerts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.sustained_drift(T.window_flags(results_table(spark, sf_dir)))
    return _fmt(r.select(T.WKEY, "alert", "alert_class", "sustained"))


@register("window_run_summary_events", f"""
WITH r AS ({RESULTS_SQL})
SELECT count(*) AS windows, count_if(coalesce(drift_detected, false) OR coalesce(model_drift_detected, false)) AS total_alerts,
  count_if(coalesce(drift_detected, false)) AS data_drift_windows, count_if(coalesce(model_drift_detected, false)) AS model_drift_windows,
  coalesce(max(drift_ratio), 0.0) AS max_drift_ratio, coalesce(max(coalesce(auc_drop, 0.0)), 0.0) AS max_auc_drop,
  min(CASE WHEN coalesce(drift_detected, false) OR coalesce(model_drift_detected, false) THEN window_start END) AS first_alert,
  sum(n_records) AS total_records FROM r""", ("T6",))
def window_run_summary_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _fmt(results_table(spark, sf_dir))
    return T.run_summary(r)


@register("window_history_events", f"""
WITH r AS ({RESULTS_SQL})
SELECT window_start, list(drift_ratio) OVER (ORDER BY window_start ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS drift_ratio_history FROM r""",
          ("T7",))
def window_history_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = T.bounded_history(results_table(spark, sf_dir), "drift_ratio")
    return _fmt(r.select(T.WKEY, "drift_ratio_history"))


@register("window_alert_runs_events", f"""
WITH r AS ({RESULTS_SQL}),
i AS (SELECT *, row_number() OVER (ORDER BY window_start) AS idx FROM r),
f AS (SELECT idx FROM i WHERE coalesce(model_drift_detected, false)),
g AS (SELECT idx, idx - row_number() OVER (ORDER BY idx) AS grp FROM f)
SELECT min(idx) AS run_start, max(idx) AS run_end, count(*) AS length FROM g GROUP BY grp""", ("T8",))
def window_alert_runs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window
    r = results_table(spark, sf_dir).withColumn("idx", F.row_number().over(Window.orderBy(T.WKEY)))
    return T.alert_runs(r, "model_drift_detected", "idx")


@register("window_feature_matrix_events", f"""
WITH t AS ({WINDOW_TESTS_SQL}) SELECT window_start, feature, bool_or(drift_detected) AS drift_detected FROM t GROUP BY ALL""",
          ("T10",))
def window_feature_matrix_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fmt(T.feature_matrix(window_report(spark, sf_dir).tests))


@register("window_series_events", f"""
WITH r AS ({RESULTS_SQL}) SELECT window_start, drift_ratio, coalesce(auc_drop, 0.0) AS auc_drop FROM r""", ("T11",))
def window_series_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fmt(T.ratio_series(results_table(spark, sf_dir)))


@register("window_report_combined_events", f"""
WITH r AS ({RESULTS_SQL})
SELECT window_start, coalesce(drift_detected, false) OR coalesce(model_drift_detected, false) AS any_drift,
       false AS retrain_log_only, coalesce(drift_detected, false) OR coalesce(model_drift_detected, false) AS retrain FROM r""",
          ("D12", "D13"))
def window_report_combined_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = results_table(spark, sf_dir)
    d = F.coalesce(F.col("drift_detected"), F.lit(False)) | F.coalesce(F.col("model_drift_detected"), F.lit(False))
    return _fmt(r.select(T.WKEY, d.alias("any_drift"), MD.should_retrain(d, True).alias("retrain_log_only"),
                         MD.should_retrain(d, False).alias("retrain")))


# ---------------------------------------------------------------- the same monitor on a stream

@register("stream_window_verdicts_events", f"""
WITH r AS ({WINDOWS_SQL})
SELECT *, drift_detected AS alert, (row_number() OVER (ORDER BY window_start) >= 6) AND
  sum(drift_detected::INTEGER) OVER (ORDER BY window_start ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) >= 4 AS sustained FROM r""",
          ("T1", "T2", "T4", "T5", "S12"))
def stream_window_verdicts_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of the events table read as a file stream (watermark 1 hour,
    append mode); the window still open at the end of the input is closed by a final flush."""
    from tidewatch.streaming import window_monitor as S
    ref, _ = split(spark, sf_dir)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def features(df: DataFrame) -> DataFrame:
        return df.select(F.col("ts").cast("timestamp").alias("ts"), "value",
                         F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type").where(
            F.col("ts") >= F.lit(CUT).cast("timestamp"))

    out = S.run_to_completion(spark, features(raw), ref, "ts", FEATURES, duration="1 day", watermark="1 hour",
                              bounded=features(spark.read.parquet(f"{sf_dir}/events.parquet")))
    _, windows = S.read_results(spark, out)
    flagged = T.sustained_drift(T.window_flags(windows.drop("batch_id").withColumn(
        "model_drift_detected", F.lit(False))))
    return _fmt(flagged.select(T.WKEY, "n_records", "drift_count", "n_features", F.round("drift_ratio", R6).alias("drift_ratio"),
                               "drift_detected", "alert", "sustained"))
