"""Model drift (D9-D13): performance and score-distribution change of a scored
current table against a scored reference, per group (e.g. per window)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import drift as D
from tidewatch.operators import evaluate as E
from tidewatch.operators.columns import attach_row, col
from tidewatch.operators.monitor import windowed_psi

AUC_DROP_THRESHOLD = 0.05
PREDICTION_PSI_THRESHOLD = 0.1


def _side_metrics(df: DataFrame, label: str, score: str, prediction: str, groups: Sequence[str], prefix: str) -> DataFrame:
    acc = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"),
                                  F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))
    rank = E.ranking_metrics(df, label, score, groups).select(*groups, "auc", "avg_precision")
    m = acc.join(rank, list(groups), "left") if groups else attach_row(acc, rank)
    return m.select(*groups, *[F.col(c).alias(f"{prefix}_{c}") for c in ("n", "accuracy", "auc", "avg_precision")])


def model_drift(reference: DataFrame, current: DataFrame, label: str, score: str = "probability",
                prediction: str = "prediction", groups: Sequence[str] = (),
                auc_drop_threshold: float = AUC_DROP_THRESHOLD,
                prediction_psi_threshold: float = PREDICTION_PSI_THRESHOLD) -> DataFrame:
    """One row per group of ``current`` with reference and current metrics,
    the AUC drop (null when either AUC is null), the PSI of the scores and the
    verdicts. Unlike the reference, the score-PSI threshold is applied."""
    groups = list(groups)
    gkey = groups[0] if groups else "_g"
    cur = current if groups else current.withColumn("_g", F.lit(0))
    ref_m = _side_metrics(reference, label, score, prediction, [], "reference")
    cur_m = _side_metrics(cur, label, score, prediction, [gkey], "current")
    ref_counts = (reference.where(col(score).isNotNull())
                  .groupBy(F.lit("prediction_score").alias("feature"), col(score).cast("double").alias("value"))
                  .agg(F.count(F.lit(1)).alias("n_ref")))
    cur_counts = (cur.where(col(score).isNotNull())
                  .groupBy(col(gkey).alias(gkey), F.lit("prediction_score").alias("feature"),
                           col(score).cast("double").alias("value"))
                  .agg(F.count(F.lit(1)).alias("n_cur")))
    psi = windowed_psi(ref_counts, cur_counts, key=gkey).select(gkey, F.col("statistic").alias("prediction_psi"))
    out = attach_row(cur_m, ref_m).join(psi, gkey, "left")
    drop = F.col("reference_auc") - F.col("current_auc")
    out = (out.withColumn("auc_drop", drop)
              .withColumn("performance_drift", F.coalesce(F.col("auc_drop") > auc_drop_threshold, F.lit(False)))
              .withColumn("prediction_drift", F.coalesce(F.col("prediction_psi") > prediction_psi_threshold, F.lit(False)))
              .withColumn("model_drift_detected", F.col("performance_drift") | F.col("prediction_drift")))
    return out.drop("_g") if not groups else out


def combine_reports(data_summary: DataFrame, model_summary: DataFrame | None, keys: Sequence[str] = ()) -> DataFrame:
    """Drift if either report fired (a missing report counts as no drift)."""
    if model_summary is None:
        out = data_summary.withColumn("model_drift_detected", F.lit(None).cast("boolean"))
    elif keys:
        out = data_summary.join(model_summary, list(keys), "full_outer")
    else:
        out = attach_row(data_summary, model_summary)
    d = F.coalesce(F.col("data_drift_detected"), F.lit(False)) if "data_drift_detected" in out.columns \
        else F.coalesce(F.col("drift_detected"), F.lit(False))
    return out.withColumn("any_drift", d | F.coalesce(F.col("model_drift_detected"), F.lit(False)))


def should_retrain(flag: Column, log_only: bool = True) -> Column:
    """Never when log-only, else the combined drift flag."""
    return F.lit(False) if log_only else F.coalesce(flag, F.lit(False))
