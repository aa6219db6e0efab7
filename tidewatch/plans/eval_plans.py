"""Evaluation queries (E1-E10, M6, C15) on ``lineitem`` and ``labels`` with a
fixed-coefficient logistic score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as E
from tidewatch.operators.scoring import logistic_score
from tidewatch.plans.catalog import register
from tidewatch.sources.tables import read_table

R6 = 6
# Fixed coefficients of the demonstration model (not fitted here).
LI_WEIGHTS = {"l_discount": 8.0, "l_quantity": 0.02, "l_tax": -10.0}
LI_INTERCEPT = -0.6

LI_SCORED_SQL = f"""SELECT l_orderkey, l_linenumber, l_linestatus, (l_returnflag = 'R')::INTEGER AS label,
  round(1.0 / (1.0 + exp(-({LI_INTERCEPT} + 8.0 * l_discount + 0.02 * l_quantity + -10.0 * l_tax))), 12) AS probability
FROM lineitem"""


def li_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", "l_discount", "l_quantity", "l_tax",
        (F.col("l_returnflag") == "R").cast("int").alias("label"))
    # scores rounded to 12 digits so that ties do not depend on the engine's last ulp
    return logistic_score(li, LI_WEIGHTS, LI_INTERCEPT, digits=12)


def _r(df, cols):
    return df.select(*[F.round(c, R6).alias(c) if c in cols else F.col(c) for c in df.columns])


def _metrics_sql(scored: str, groups: str = "") -> str:
    g = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    return f"""
WITH s AS ({scored}),
p AS (SELECT *, (probability >= 0.5)::INTEGER AS prediction FROM s),
cm AS (SELECT {g}count(*) AS n, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
         count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp FROM p GROUP BY ALL),
c AS (SELECT {g}probability AS score, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg
      FROM s GROUP BY ALL),
l AS (SELECT *, sum(n_pos) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp,
             sum(n_neg) OVER ({part}ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn FROM c),
r AS (SELECT {g}sum(n_pos) AS NP, sum(n_neg) AS NN, sum(n_neg * (cp - n_pos + n_pos / 2.0)) AS a,
             sum(CASE WHEN n_pos > 0 THEN n_pos * (cp / (cp + cn)) END) AS ap FROM l GROUP BY ALL)
SELECT {('cm.' + groups + ', ') if groups else ''}cm.n, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 6) AS accuracy,
  round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 6) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 6) AS recall,
  round(coalesce(2 * coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) * coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0)
        / nullif(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) + coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 0), 0.0), 6) AS f1,
  tn, fp, fn, tp,
  round(CASE WHEN NP > 0 AND NN > 0 THEN a / (NP * NN) END, 6) AS auc, round(CASE WHEN NP > 0 AND NN > 0 THEN ap / NP END, 6) AS avg_precision
FROM cm JOIN r {('USING (' + groups + ')') if groups else 'ON TRUE'}"""


METRIC_COLS = ["accuracy", "precision", "recall", "f1", "auc", "avg_precision"]


@register("eval_lineitem_metrics", _metrics_sql(LI_SCORED_SQL), ("E1", "E3", "E5", "E6", "M6", "C15"))
def eval_lineitem_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.classification_metrics(li_scored(spark, sf_dir), "label", "prediction", "probability")
    return _r(m, METRIC_COLS)


@register("eval_lineitem_by_status", _metrics_sql(LI_SCORED_SQL, "l_linestatus"), ("E1", "E5", "E6", "D11"))
def eval_lineitem_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = E.classification_metrics(li_scored(spark, sf_dir), "label", "prediction", "probability", groups=["l_linestatus"])
    return _r(m, METRIC_COLS)


@register("eval_roc_lineitem", f"""
WITH s AS ({LI_SCORED_SQL}),
c AS (SELECT probability AS score, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg FROM s GROUP BY ALL),
l AS (SELECT *, sum(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
             sum(n_pos) OVER () AS P, sum(n_neg) OVER () AS N FROM c)
SELECT round(score, 6) AS threshold, round(cn::DOUBLE / N, 6) AS fpr, round(cp::DOUBLE / P, 6) AS tpr FROM l
UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0""", ("E4",))
def eval_roc_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(E.roc_points(li_scored(spark, sf_dir), "label", "probability"), ["threshold", "fpr", "tpr"])


@register("eval_pr_lineitem", f"""
WITH s AS ({LI_SCORED_SQL}),
c AS (SELECT probability AS score, count(*) FILTER (WHERE label = 1) AS n_pos, count(*) FILTER (WHERE label <> 1) AS n_neg FROM s GROUP BY ALL),
l AS (SELECT *, sum(n_pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cp, sum(n_neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cn,
             sum(n_pos) OVER () AS P FROM c)
SELECT round(score, 6) AS threshold, round(coalesce(cp::DOUBLE / nullif(cp + cn, 0), 0.0), 6) AS precision, round(cp::DOUBLE / P, 6) AS recall
FROM l
UNION ALL SELECT NULL::DOUBLE, 1.0, 0.0""", ("E7",))
def eval_pr_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(E.pr_points(li_scored(spark, sf_dir), "label", "probability"), ["threshold", "precision", "recall"])


@register("eval_detection_summary", f"""
WITH p AS (SELECT *, (probability >= 0.5)::INTEGER AS prediction FROM ({LI_SCORED_SQL}))
SELECT count(*) FILTER (WHERE label = prediction) AS correct, count(*) AS total,
  count(*) FILTER (WHERE label = 1 AND prediction = 1) AS failures_found, count(*) FILTER (WHERE label = 1) AS failures_total,
  count(*) FILTER (WHERE label = 0 AND prediction = 0) AS converted_found, count(*) FILTER (WHERE label = 0) AS converted_total,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS false_positives, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS false_negatives,
  round(avg((label = prediction)::DOUBLE), 6) AS accuracy FROM p""", ("E8", "E10", "P6"))
def eval_detection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = li_scored(spark, sf_dir)
    d = E.detection_summary(s, "label", "prediction")
    a = E.plain_accuracy(s, "label", "prediction").select(F.round("accuracy", R6).alias("accuracy"))
    from tidewatch.operators.columns import attach_row
    return attach_row(d, a)


DOC_SCORE_SQL = """SELECT l.doc_id, l.quality AS label, round(1.0 / (1.0 + exp(-(ln(d.n_chars + 1.0) * 0.5 - 3.0))), 12) AS probability
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


@register("eval_quality_by_length", _metrics_sql(DOC_SCORE_SQL), ("E1", "E5", "E6"))
def eval_quality_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = read_table(spark, sf_dir, "labels")
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    j = lb.join(d, "doc_id").select("doc_id", F.col("quality").alias("label"),
                                    F.round(1.0 / (1.0 + F.exp(-(F.log(F.col("n_chars") + 1.0) * 0.5 - 3.0))), 12).alias("probability"))
    j = j.withColumn("prediction", (F.col("probability") >= 0.5).cast("int"))
    return _r(E.classification_metrics(j, "label", "prediction", "probability"), METRIC_COLS)
