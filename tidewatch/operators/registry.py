"""Model registry rules (R1-R9) over a registry table.

The registry is a table with one row per trained model version: ``aim``,
``model`` (family), ``version`` (text such as ``v12``) and metric columns.
Every rule is a window or an aggregate partitioned by aim, so all aims are
resolved in the same job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.normalize import version_number
from tidewatch.operators.columns import col


def _clean(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def with_score(registry: DataFrame, metric: str = "cv_auc_mean", fallback: str | None = "train_auc") -> DataFrame:
    """Adds ``version_num`` (C16) and ``score``: the metric, or the fallback when it is null / NaN."""
    score = _clean(col(metric).cast("double"))
    if fallback:
        score = F.coalesce(score, _clean(col(fallback).cast("double")))
    return registry.withColumn("version_num", version_number(F.col("version"))).withColumn("score", score)


def champion_by_metric(registry: DataFrame, aims: Sequence[str], metric: str = "cv_auc_mean",
                       prefix_match: bool = True) -> DataFrame:
    """Per requested aim, the row with the largest metric (null / NaN skipped, must exceed -1).

    With ``prefix_match`` an aim also matches rows of aims named ``<aim>_...``
    (the reference's file-name match). Ties go to the highest version number.
    """
    scored = with_score(registry, metric, fallback=None).where(F.col("score") > -1.0)
    wanted = registry.sparkSession.createDataFrame([(a,) for a in aims], "requested_aim string")
    cond = F.col("aim") == F.col("requested_aim")
    if prefix_match:
        cond = cond | F.col("aim").startswith(F.concat(F.col("requested_aim"), F.lit("_")))
    j = scored.join(F.broadcast(wanted), cond, "inner")  # one row per requested aim
    w = Window.partitionBy("requested_aim").orderBy(F.desc("score"), F.desc("version_num"))
    return j.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def champion_per_aim(registry: DataFrame, metric: str = "cv_auc_mean", fallback: str = "train_auc") -> DataFrame:
    """R2: exact aim, metric with fallback, ties to the highest version number."""
    scored = with_score(registry, metric, fallback).where(F.col("score") >= -1.0)
    w = Window.partitionBy("aim").orderBy(F.desc("score"), F.desc("version_num"))
    return scored.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def family_champion(registry: DataFrame, metric: str = "cv_auc_mean", fallback: str = "train_auc") -> DataFrame:
    """Per aim, the family with the best score (ties to the first family
    name), then the latest scored version of that family."""
    scored = with_score(registry, metric, fallback).where(F.col("score").isNotNull())
    fam = scored.groupBy("aim", "model").agg(F.max("score").alias("family_score"))
    wf = Window.partitionBy("aim").orderBy(F.desc("family_score"), F.asc("model"))
    best = (fam.where(F.col("family_score") > -1.0).withColumn("_rn", F.row_number().over(wf))
            .where(F.col("_rn") == 1).select("aim", "model", "family_score"))
    inside = scored.join(best, ["aim", "model"], "inner")
    wv = Window.partitionBy("aim").orderBy(F.desc("version_num"))
    return inside.withColumn("_rn", F.row_number().over(wv)).where(F.col("_rn") == 1).drop("_rn")


def model_info(registry: DataFrame, aim: str, model: str | None = None, version: str | None = None) -> DataFrame:
    """The exact (aim, model, version) row, or the R2 champion of the aim when not both given."""
    if model is not None and version is not None:
        return with_score(registry).where((F.col("aim") == aim) & (F.col("model") == model) & (F.col("version") == version))
    return champion_per_aim(registry).where(F.col("aim") == aim)


def latest_version(registry: DataFrame, aims: Sequence[str] | None = None) -> DataFrame:
    """The highest version number per aim (numeric, so v10 beats v9)."""
    r = with_score(registry)
    if aims is not None:
        r = r.where(F.col("aim").isin(list(aims)))
    w = Window.partitionBy("aim").orderBy(F.desc("version_num"), F.desc("version"))
    return r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def champion_features(registry: DataFrame, features_col: str = "features") -> DataFrame:
    """The feature list of each aim's R2 champion, one row per feature with its position."""
    ch = champion_per_aim(registry)
    return ch.select("aim", "model", "version", F.posexplode(features_col).alias("position", "feature"))


def resolve_models(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests (aim, model, version; model/version may be null) -> the exact
    registry row when both are given and exist, else the aim's R2 champion.
    ``resolved`` says which; requests with neither get null model columns."""
    reg = with_score(registry)
    exact = reg.select(F.col("aim").alias("_a"), F.col("model").alias("_m"), F.col("version").alias("_v"),
                       F.col("model_path").alias("exact_path"))
    ch = champion_per_aim(registry).select("aim", F.col("model").alias("champ_model"),
                                           F.col("version").alias("champ_version"),
                                           F.col("model_path").alias("champ_path"))
    j = requests.join(exact, (F.col("aim") == F.col("_a")) & (F.col("model") == F.col("_m"))
                      & (F.col("version") == F.col("_v")), "left").drop("_a", "_m", "_v")
    j = j.join(ch, "aim", "left")
    hit = F.col("exact_path").isNotNull()
    return j.select(
        "request_id", "aim",
        F.when(hit, F.col("model")).otherwise(F.col("champ_model")).alias("resolved_model"),
        F.when(hit, F.col("version")).otherwise(F.col("champ_version")).alias("resolved_version"),
        F.coalesce("exact_path", "champ_path").alias("model_path"),
        F.when(hit, "exact").when(F.col("champ_path").isNotNull(), "champion").otherwise("none").alias("resolved"))


def runs_summary(registry: DataFrame, metrics: Sequence[str] = ("cv_auc_mean", "train_auc")) -> DataFrame:
    """One display row per run with metrics formatted to 3 decimals."""
    return registry.select("aim", "model", "version",
                           *[F.format_number(col(m).cast("double"), 3).alias(m) for m in metrics])
