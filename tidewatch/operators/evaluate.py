"""Classification metrics over scored tables.

Ranking metrics use exact running sums over distinct scores from the value
ladder: the scored table is first aggregated to (score, n_pos, n_neg), so
ties are handled exactly and a hot score value is one row. ``groups`` runs
every metric per group (e.g. per side or per window) in the same jobs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.columns import col
from tidewatch.operators.ladder import value_ladder


def score_counts(df: DataFrame, label: str, score: str, groups: Sequence[str] = ()) -> DataFrame:
    return (df.where(col(score).isNotNull() & col(label).isNotNull())
            .groupBy(*[col(g).alias(g) for g in groups], col(score).cast("double").alias("score"))
            .agg(F.count_if(col(label) == 1).alias("n_pos"), F.count_if(col(label) != 1).alias("n_neg")))


def ranking_metrics(df: DataFrame, label: str, score: str, groups: Sequence[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """E5 + E6: exact ROC AUC (ties count one half) and step-wise average precision.

    AUC = sum_v n_neg(v) * (pos strictly above v + n_pos(v) / 2) / (P * N);
    AP = sum_v n_pos(v) / P * precision at threshold v. Both null when one
    class is absent.
    """
    keys = list(groups)
    counts = score_counts(df, label, score, groups)
    if not keys:
        counts = counts.withColumn("_g", F.lit(0))
        keys = ["_g"]
    lad = value_ladder(counts, keys, "score", ["n_pos", "n_neg"], buckets=buckets, descending=True)
    above_pos = F.col("cum_n_pos") - F.col("n_pos")
    auc_term = F.col("n_neg") * (above_pos + F.col("n_pos") / 2.0)
    ap_term = F.when(F.col("n_pos") > 0, F.col("n_pos") * (F.col("cum_n_pos") / (F.col("cum_n_pos") + F.col("cum_n_neg"))))
    agg = lad.groupBy(*keys).agg(F.first("tot_n_pos").alias("P"), F.first("tot_n_neg").alias("N"),
                                 F.sum(auc_term).alias("_auc"), F.sum(ap_term).alias("_ap"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    out = agg.select(*keys, F.col("P").alias("n_pos"), F.col("N").alias("n_neg"),
                     F.when(both, F.col("_auc") / F.col("P").cast("double") / F.col("N").cast("double")).alias("auc"),
                     F.when(both, F.col("_ap") / F.col("P")).alias("avg_precision"))
    return out.drop("_g") if not groups else out


def confusion(df: DataFrame, label: str, prediction: str, groups: Sequence[str] = ()) -> DataFrame:
    """Tn, fp, fn, tp with labels [0, 1]."""
    y, p = col(label), col(prediction)
    return df.groupBy(*[col(g).alias(g) for g in groups]).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))


def _rates(c: DataFrame) -> list[Column]:
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return [F.try_divide(tp + tn, tp + tn + fp + fn).alias("accuracy"), precision.alias("precision"),
            recall.alias("recall"), f1.alias("f1")]


def classification_metrics(df: DataFrame, label: str, prediction: str, score: str | None = None,
                           groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 on zero division), confusion
    counts, and AUC / AP when a score is given."""
    c = confusion(df, label, prediction, groups)
    out = c.select(*groups, (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), *_rates(c),
                   "tn", "fp", "fn", "tp")
    if score:
        r = ranking_metrics(df, label, score, groups, buckets).select(*groups, "auc", "avg_precision")
        out = out.join(r, list(groups), "left") if groups else _one_row_join(out, r)
    return out


def _one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    from tidewatch.operators.columns import attach_row
    return attach_row(a, b)


def roc_points(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """ROC points at every distinct score (descending), with the (0, 0) start
    at an infinite threshold. All thresholds are kept (no collinear-point pruning)."""
    keys = list(groups) or ["_g"]
    counts = score_counts(df, label, score, groups)
    if not groups:
        counts = counts.withColumn("_g", F.lit(0))
    lad = value_ladder(counts, keys, "score", ["n_pos", "n_neg"], buckets=buckets, descending=True)
    pts = lad.select(*keys, F.col("score").alias("threshold"),
                     F.try_divide(F.col("cum_n_neg").cast("double"), F.col("tot_n_neg")).alias("fpr"),
                     F.try_divide(F.col("cum_n_pos").cast("double"), F.col("tot_n_pos")).alias("tpr"))
    start = lad.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    out = pts.unionByName(start)
    return out.drop("_g") if not groups else out


def pr_points(df: DataFrame, label: str, score: str, groups: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Precision / recall at each distinct score, also those below the last positive, plus the (precision 1, recall 0) end point with a null threshold."""
    keys = list(groups) or ["_g"]
    counts = score_counts(df, label, score, groups)
    if not groups:
        counts = counts.withColumn("_g", F.lit(0))
    lad = value_ladder(counts, keys, "score", ["n_pos", "n_neg"], buckets=buckets, descending=True)
    pts = lad.select(*keys, F.col("score").alias("threshold"),
                      F.coalesce(F.try_divide(F.col("cum_n_pos").cast("double"), F.col("cum_n_pos") + F.col("cum_n_neg")),
                                 F.lit(0.0)).alias("precision"),
                      F.try_divide(F.col("cum_n_pos").cast("double"), F.col("tot_n_pos")).alias("recall"))
    end = lad.groupBy(*keys).agg(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"),
                                 F.lit(0.0).alias("recall"))
    out = pts.unionByName(end)
    return out.drop("_g") if not groups else out


def detection_summary(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Correct, failures found / total, non-failures found / total, FP, FN."""
    y, p = col(label), col(prediction)
    return df.agg(
        F.count_if(y == p).alias("correct"), F.count(F.lit(1)).alias("total"),
        F.count_if((y == 1) & (p == 1)).alias("failures_found"), F.count_if(y == 1).alias("failures_total"),
        F.count_if((y == 0) & (p == 0)).alias("converted_found"), F.count_if(y == 0).alias("converted_total"),
        F.count_if((y == 0) & (p == 1)).alias("false_positives"), F.count_if((y == 1) & (p == 0)).alias("false_negatives"))


def metric_drop(reference: Column, current: Column) -> Column:
    """Reference minus current, null when either is null."""
    return reference - current


def plain_accuracy(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean of (label == prediction)."""
    return df.agg(F.avg((col(label) == col(prediction)).cast("double")).alias("accuracy"))
