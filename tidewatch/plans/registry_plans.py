"""Registry and champion queries (R1-R9, C16) over a registry-like table
derived from ``events``: one model version per (event type, day)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import registry as R
from tidewatch.plans.catalog import register
from tidewatch.sources.tables import read_table

FAMILIES = ["logistic_regression", "random_forest", "xgboost"]
AIM1_FEATURES = ["AGE (YEARS)", "BMI", "SEX", "baseline_symptom_count"]
AIM2_FEATURES = ["AGE", "SEX", "COUGH"]


def registry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    g = ev.groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("av"), F.max("value").alias("mx"))
    aim = (F.when(F.col("event_type").isin("click", "view"), "aim1")
           .when(F.col("event_type").isin("purchase", "signup"), "aim2").otherwise("aim1_strict"))
    model = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), (F.col("d") % 3 + 1).cast("int"))
    vnum = F.when(F.col("event_type").isin("view", "signup"), 100).otherwise(0) + F.col("d")
    cv = (F.when(F.col("n") % 7 == 0, F.lit(None).cast("double"))
          .when(F.col("n") % 11 == 0, F.lit(float("nan"))).otherwise(F.round(F.col("av") / 100, 6)))
    feats = F.when(aim == "aim2", F.array(*[F.lit(f) for f in AIM2_FEATURES])).otherwise(
        F.array(*[F.lit(f) for f in AIM1_FEATURES]))
    return g.select(aim.alias("aim"), model.alias("model"), F.concat(F.lit("v"), vnum.cast("string")).alias("version"),
                    cv.alias("cv_auc_mean"), F.round(F.col("mx") / 500, 6).alias("train_auc"), feats.alias("features")
                    ).withColumn("model_path", F.concat_ws("/", F.lit("models"), "aim", "model", "version"))


def _lit_list(xs):
    return "[" + ", ".join("'" + x + "'" for x in xs) + "]"


REGISTRY_SQL = f"""SELECT aim, model, version, cv_auc_mean, train_auc, features, 'models/' || aim || '/' || model || '/' || version AS model_path,
  coalesce(TRY_CAST(nullif(regexp_extract(version, '\\d+', 0), '') AS INTEGER), 0) AS version_num,
  coalesce(CASE WHEN NOT isnan(cv_auc_mean) THEN cv_auc_mean END, CASE WHEN NOT isnan(train_auc) THEN train_auc END) AS score
FROM (SELECT CASE WHEN event_type IN ('click', 'view') THEN 'aim1' WHEN event_type IN ('purchase', 'signup') THEN 'aim2' ELSE 'aim1_strict' END AS aim,
  ({_lit_list(FAMILIES)})[1 + d % 3] AS model,
  'v' || CAST((CASE WHEN event_type IN ('view', 'signup') THEN 100 ELSE 0 END) + d AS VARCHAR) AS version,
  CASE WHEN n % 7 = 0 THEN NULL WHEN n % 11 = 0 THEN 'NaN'::DOUBLE ELSE round(av / 100, 6) END AS cv_auc_mean,
  round(mx / 500, 6) AS train_auc,
  CASE WHEN event_type IN ('purchase', 'signup') THEN {_lit_list(AIM2_FEATURES)} ELSE {_lit_list(AIM1_FEATURES)} END AS features
  FROM (SELECT event_type, day(ts) AS d, count(*) AS n, avg(value) AS av, max(value) AS mx FROM events GROUP BY ALL))"""

OUT = ["aim", "model", "version", "score"]


@register("registry_champion_by_metric", f"""
WITH r AS ({REGISTRY_SQL}), q AS (SELECT * FROM (VALUES ('aim1'), ('aim2')) t(requested_aim)),
j AS (SELECT q.requested_aim, r.*, CASE WHEN NOT isnan(r.cv_auc_mean) THEN r.cv_auc_mean END AS m FROM r JOIN q
      ON r.aim = q.requested_aim OR starts_with(r.aim, q.requested_aim || '_'))
SELECT requested_aim, aim, model, version, m AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY requested_aim ORDER BY m DESC, version_num DESC) AS rn FROM j WHERE m > -1.0) WHERE rn = 1""",
          ("R1", "C16"))
def registry_champion_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.champion_by_metric(registry_view(spark, sf_dir), ["aim1", "aim2"]).select("requested_aim", *OUT)


@register("registry_champion", f"""
WITH r AS ({REGISTRY_SQL})
SELECT aim, model, version, score FROM (
  SELECT *, row_number() OVER (PARTITION BY aim ORDER BY score DESC, version_num DESC) AS rn FROM r WHERE score >= -1.0) WHERE rn = 1""",
          ("R2",))
def registry_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.champion_per_aim(registry_view(spark, sf_dir)).select(*OUT)


@register("registry_family_champion", f"""
WITH r AS ({REGISTRY_SQL}), s AS (SELECT * FROM r WHERE score IS NOT NULL),
f AS (SELECT aim, model, max(score) AS family_score FROM s GROUP BY ALL),
b AS (SELECT aim, model, family_score FROM (SELECT *, row_number() OVER (PARTITION BY aim ORDER BY family_score DESC, model ASC) AS rn
      FROM f WHERE family_score > -1.0) WHERE rn = 1)
SELECT aim, model, version, score, family_score FROM (
  SELECT s.*, b.family_score, row_number() OVER (PARTITION BY s.aim ORDER BY s.version_num DESC) AS rn FROM s JOIN b USING (aim, model)) WHERE rn = 1""",
          ("R3", "R4"))
def registry_family_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.family_champion(registry_view(spark, sf_dir)).select(*OUT, "family_score")


@register("registry_latest", f"""
WITH r AS ({REGISTRY_SQL})
SELECT aim, model, version, score FROM (
  SELECT *, row_number() OVER (PARTITION BY aim ORDER BY version_num DESC, version DESC) AS rn FROM r) WHERE rn = 1""", ("R6",))
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest_version(registry_view(spark, sf_dir)).select(*OUT)


@register("registry_champion_features", f"""
WITH r AS ({REGISTRY_SQL}),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aim ORDER BY score DESC, version_num DESC) AS rn FROM r WHERE score >= -1.0) WHERE rn = 1)
SELECT aim, model, version, (i - 1)::INTEGER AS position, features[i] AS feature FROM c, range(1, 5) t(i) WHERE i <= len(features)""",
          ("R7",))
def registry_champion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.champion_features(registry_view(spark, sf_dir))


def _requests(reg: DataFrame) -> DataFrame:
    vn = F.regexp_extract("version", r"\d+", 0).cast("int")
    return reg.select(F.concat_ws(":", "aim", "version").alias("request_id"), "aim", "model",
                      F.when(vn % 4 == 0, F.col("version")).otherwise(F.lit("v999")).alias("version"))


@register("registry_resolve", f"""
WITH r AS ({REGISTRY_SQL}),
q AS (SELECT aim || ':' || version AS request_id, aim, model, CASE WHEN version_num % 4 = 0 THEN version ELSE 'v999' END AS version FROM r),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aim ORDER BY score DESC, version_num DESC) AS rn FROM r WHERE score >= -1.0) WHERE rn = 1)
SELECT q.request_id, q.aim, CASE WHEN e.model_path IS NOT NULL THEN q.model ELSE c.model END AS resolved_model,
  CASE WHEN e.model_path IS NOT NULL THEN q.version ELSE c.version END AS resolved_version,
  coalesce(e.model_path, c.model_path) AS model_path,
  CASE WHEN e.model_path IS NOT NULL THEN 'exact' WHEN c.model_path IS NOT NULL THEN 'champion' ELSE 'none' END AS resolved
FROM q LEFT JOIN r e ON e.aim = q.aim AND e.model = q.model AND e.version = q.version LEFT JOIN c ON c.aim = q.aim""",
          ("R9", "R5"))
def registry_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = registry_view(spark, sf_dir)
    return R.resolve_models(_requests(reg), reg)


@register("registry_summary", f"""
WITH r AS ({REGISTRY_SQL})
SELECT aim, model, version, printf('%.3f', CASE WHEN NOT isnan(cv_auc_mean) THEN cv_auc_mean END) AS cv_auc_mean,
       printf('%.3f', train_auc) AS train_auc FROM r""", ("R8",))
def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    reg = registry_view(spark, sf_dir).withColumn("cv_auc_mean", F.when(~F.isnan("cv_auc_mean"), F.col("cv_auc_mean")))
    return R.runs_summary(reg)


@register("registry_model_info", f"""
WITH r AS ({REGISTRY_SQL}),
c AS (SELECT *, row_number() OVER (PARTITION BY aim ORDER BY score DESC, version_num DESC) AS rn FROM r WHERE score >= -1.0),
one AS (SELECT min(aim) AS aim FROM r), e AS (SELECT min((model, version)) AS k FROM r, one WHERE r.aim = one.aim)
SELECT 'champion' AS request, c.aim, c.model, c.version, c.score FROM c, one WHERE c.rn = 1 AND c.aim = one.aim
UNION ALL SELECT 'exact', r.aim, r.model, r.version, r.score FROM r, one, e WHERE r.aim = one.aim AND r.model = e.k[1] AND r.version = e.k[2]""",
          ("R5",))
def registry_model_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion of the first aim, and one exact (model, version) of it."""
    reg = registry_view(spark, sf_dir)
    first = reg.agg(F.min(F.struct("aim", "model", "version")).alias("k")).select("k.*").first()
    champion = R.model_info(reg, first["aim"]).select(F.lit("champion").alias("request"), *OUT)
    exact = R.model_info(reg, first["aim"], first["model"], first["version"]).select(F.lit("exact").alias("request"), *OUT)
    return champion.unionByName(exact)
