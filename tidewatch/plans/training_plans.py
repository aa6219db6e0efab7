"""Oversampling, projections by aim, file scoring, explanation records and exact KS."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.ks_exact import ks_pvalue_auto
from tidewatch.operators import attribution as X
from tidewatch.operators import clean as K
from tidewatch.operators import drift
from tidewatch.operators import explain_records as R
from tidewatch.operators import models as M
from tidewatch.operators import projections as P
from tidewatch.operators import scoring
from tidewatch.operators.columns import col
from tidewatch.operators.ladder import value_ladder
from tidewatch.operators.smote import synthetic_rows
from tidewatch.plans import clean_plans as C
from tidewatch.plans import oracle_sql as O
from tidewatch.plans.attribution_plans import PHI_SQL, SLOT_FEATURE, SLOT_MAP_SQL, _hash_sql, _r, li_phi, li_rows
from tidewatch.plans.catalog import register
from tidewatch.plans.eval_plans import LI_INTERCEPT, LI_SCORED_SQL, LI_WEIGHTS
from tidewatch.plans.sink_plans import scratch
from tidewatch.sources import sinks as SK
from tidewatch.sources.tables import read_table

R6 = 6


# ---------------------------------------------------------------- I12

def _draw_sql(salt: str) -> str:
    return f"('0x' || substr(md5(CAST(s AS VARCHAR) || '|{salt}'), 1, 13))::BIGINT"


SMOTE_SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x, (label = 0)::INTEGER AS label
           FROM embeddings WHERE embedding IS NOT NULL),
c AS (SELECT count(*) FILTER (WHERE label = 0) - count(*) FILTER (WHERE label = 1) AS need,
             count(*) FILTER (WHERE label = 1) AS n, least(5, count(*) FILTER (WHERE label = 1) - 1) AS k FROM e),
m AS (SELECT row_number() OVER (ORDER BY {_hash_sql('vec_id', 42)}, vec_id) - 1 AS pos, vec_id, x FROM e WHERE label = 1),
d AS (SELECT a.pos, b.pos AS other, list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist
      FROM m a JOIN m b ON a.pos <> b.pos),
nn AS (SELECT pos, other, row_number() OVER (PARTITION BY pos ORDER BY dist, other) - 1 AS nth FROM d QUALIFY nth < 5),
s AS (SELECT s, {_draw_sql('pick42')} % (n * k) AS pick, ({_draw_sql('gap42')}::DOUBLE + 0.5) / 4503599627370496.0 AS gap, k
      FROM c, range(0, (SELECT need FROM c)) t(s))
SELECT s.s AS synthetic_id, 1 AS label, a.vec_id AS base_id, b.vec_id AS neighbour_id, dims.i - 1 AS dim,
       round(a.x[dims.i] + gap * (b.x[dims.i] - a.x[dims.i]), 6) AS value
FROM s JOIN m a ON a.pos = pick // k JOIN nn ON nn.pos = a.pos AND nn.nth = pick % k JOIN m b ON b.pos = nn.other,
     LATERAL (SELECT unnest(range(1, len(a.x) + 1)) AS i) dims"""


@register("smote_embeddings", SMOTE_SQL, ("I12",))
def smote_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic rows for one embedding class against all others."""
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("label") == 0).cast("int").alias("label"))
    rows = synthetic_rows(e, "label", ["vec_id"], "x", 42)
    return rows.select("synthetic_id", "label", F.col("base.vec_id").alias("base_id"), F.col("neighbour.vec_id").alias("neighbour_id"),
                       F.posexplode("x").alias("dim", "value")).withColumn("value", F.round("value", R6))


# ---------------------------------------------------------------- I10, I11

def _quoted(names) -> str:
    return ", ".join(C._q(n) for n in names)


_AIM1 = [c for c in P.AIM_FEATURES["aim1"] if c in set(K.DEMO_SYMPTOMS) | {"SEX", "AGE (YEARS)", "SMOKES", "TB_CONTACT", "BASELINE_POSITIVE"}]
_AIM1_LABELS_SQL = C.AIM1_ORACLE.replace("COUGH, HEMOPTYSIS,", _quoted(K.DEMO_SYMPTOMS) + ",", 1)


@register("projection_aim1_patients", f"""SELECT RECORD, {_quoted(_AIM1)}, TARGET_NON_CONVERSION_ANY
FROM ({_AIM1_LABELS_SQL}) WHERE TARGET_NON_CONVERSION_ANY IS NOT NULL""", ("I11",))
def projection_aim1_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.imputed_label_dataset(C.patients_view(spark, sf_dir), C.demographics_view(spark, sf_dir))
    return P.project(K.with_bmi(df), "aim1", ("RECORD",))[0]


_AIM2 = [c for c in P.AIM_FEATURES["aim2"] if c in set(K.FOLLOWUP_SYMPTOMS) | {"AGE", "SEX", "WEIGHT", "HIV STATUS"}]


@register("projection_aim2_contacts", f"SELECT RECORD, {_quoted(_AIM2)}, TARGET_SYMPTOM_PRESENT FROM ({C.CONTACT_ORACLE})", ("I11",))
def projection_aim2_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.project(K.contact_dataset(C.contacts_view(spark, sf_dir)), "aim2", ("RECORD",))[0]


STRICT_MATRIX_SQL = f"""
WITH st AS ({C.STRICT_ORACLE}), q AS ({C.patients_sql()}),
j AS (SELECT st.*, coalesce({C.sex_sql('q.SEX')}, 'NO') AS SEX, {C.dbl_sql('q."AGE (YEARS)"')} AS age
      FROM st JOIN q ON st.RECORD = q.RECORD WHERE TARGET_STRICT_M2 IS NOT NULL),
f AS (SELECT *, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM j)) AS a, baseline_symptom_count::DOUBLE AS b FROM j),
s AS (SELECT avg(a) AS am, stddev_pop(a) AS asd, avg(b) AS bm, stddev_pop(b) AS bsd FROM f)
SELECT RECORD, TARGET_STRICT_M2, "Sample ID", M2_DISCORDANT, round((a - am) / asd, 6) AS "AGE (YEARS)",
       round((b - bm) / bsd, 6) AS baseline_symptom_count, (SEX = 'F')::DOUBLE AS SEX_F, (SEX = 'M')::DOUBLE AS SEX_M,
       (SEX = 'NO')::DOUBLE AS SEX_NO, (SEX = 'X')::DOUBLE AS SEX_X FROM f, s"""


@register("strict_matrix_patients", STRICT_MATRIX_SQL, ("I10", "I4", "I6", "K5"))
def strict_matrix_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    strict = K.strict_label_dataset(C.patients_view(spark, sf_dir), C.demographics_view(spark, sf_dir))
    _, m = P.strict_matrix(strict, ("RECORD",))
    return m.select(*[F.round(col(c), R6).alias(c) if c in ("AGE (YEARS)", "baseline_symptom_count") else col(c) for c in m.columns])


# ---------------------------------------------------------------- M8

SCORE_SQL = f"""SELECT l_orderkey, l_linenumber, round(probability, 6) AS probability, (probability >= 0.5)::INTEGER AS prediction,
  round(greatest(probability, 1.0 - probability), 6) AS confidence FROM ({LI_SCORED_SQL})"""


def _score_files(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "lineitem").select("l_linenumber", *LI_WEIGHTS, "l_orderkey", "l_returnflag")
    source = SK.write_table(rows, scratch(spark, "score-in"), fmt)
    scored = scoring.score_files(spark, source, scratch(spark, "score-out"), LI_WEIGHTS, LI_INTERCEPT,
                                 {"l_orderkey": "long", "l_linenumber": "int"}, fmt)
    return _r(scored, ["probability", "confidence"]).select("l_orderkey", "l_linenumber", "probability", "prediction", "confidence")


@register("batch_score_csv_lineitem", SCORE_SQL, ("M8", "M6", "S6"))
def batch_score_csv_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_files(spark, sf_dir, "csv")


@register("batch_score_json_lineitem", SCORE_SQL, ("M8", "M6", "S14"))
def batch_score_json_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_files(spark, sf_dir, "json")


# ---------------------------------------------------------------- X8

@register("explanation_record_lineitem", f"""{PHI_SQL}
SELECT 'returns' AS aim, 'logistic_regression' AS model, 'v1' AS version, slot AS feature, round(avg(abs(phi)), 6) AS mean_abs,
       round(stddev_pop(phi), 6) AS std, round(any_value(b.base_value), 6) AS base_value, count(*) AS n_background_samples
FROM p, b GROUP BY slot""", ("X8", "X3"))
def explanation_record_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi, base = li_phi(spark, sf_dir)
    n = read_table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_background_samples"))
    where = ("returns", "logistic_regression", "v1")
    path = R.save_records(R.global_record(X.global_attribution(phi), base, n, *where), scratch(spark, "explanations"))
    found = R.load_records(spark, path, R.GLOBAL_SCHEMA, *where)
    rows = found.select("aim", "model", "version", "base_value", "n_background_samples",
                        F.inline(F.arrays_zip("feature_names", "mean_abs_shap", "std_shap")))
    return _r(rows.withColumnsRenamed({"feature_names": "feature", "mean_abs_shap": "mean_abs", "std_shap": "std"}), ["mean_abs", "std", "base_value"])


INSTANCE_SCHEMA = ("l_orderkey long, l_linenumber int, prediction int, probability double, base_value double, "
                   "shap_values map<string, double>, feature_names array<string>, generated_at timestamp")


@register("explanation_instances_lineitem", f"""{PHI_SQL},
f AS (SELECT rid, l_orderkey, l_linenumber, feature, sum(phi) AS phi FROM p JOIN {SLOT_MAP_SQL} USING (slot) GROUP BY ALL),
g AS (SELECT rid, l_orderkey, l_linenumber, 1.0 / (1.0 + exp(-(any_value(b.base_value) + sum(phi)))) AS probability,
             any_value(b.base_value) AS base_value, any_value(phi) FILTER (feature = 'l_discount') AS discount FROM f, b GROUP BY ALL)
SELECT l_orderkey, l_linenumber, (round(probability, 9) >= 0.5)::INTEGER AS prediction, round(probability, 6) AS probability,
       round(base_value, 6) AS base_value, round(discount, 6) AS discount FROM g""", ("X8", "X9"))
def explanation_instances_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, base = li_rows(spark, sf_dir)
    where = ("returns", "logistic_regression", "v1")
    records = R.instance_records(X.fold_slots(rows, SLOT_FEATURE), base, ["l_orderkey", "l_linenumber"], *where)
    found = R.load_records(spark, R.save_records(records, scratch(spark, "explanations")), INSTANCE_SCHEMA, *where)
    return _r(found.withColumn("discount", F.coalesce(F.try_element_at("shap_values", F.lit("l_discount")), F.lit(0.0))),
              ["probability", "base_value", "discount"]).select(
                  "l_orderkey", "l_linenumber", "prediction", "probability", "base_value", "discount")


# ---------------------------------------------------------------- D1

_KS_SQL = f"""
src AS (SELECT CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END AS side, c_acctbal, c_custkey FROM customer),
nl AS (SELECT side, 'c_acctbal' AS feature, c_acctbal::DOUBLE AS v FROM src
       UNION ALL SELECT side, 'c_custkey', c_custkey::DOUBLE FROM src),
{O.num_counts('nl', 'nc')}, {O.ladder('nc', 'lad')}, {O.ks('lad', 'ks')},
st AS (SELECT feature, statistic, R::BIGINT AS n, C::BIGINT AS m, round(statistic * R * C)::BIGINT AS edge FROM ks_d),
walk(feature, n, m, edge, t, gone) AS (
  SELECT feature, n, m, edge, 0::BIGINT, list_transform(range(0, n + 3), lambda x: CASE WHEN x = 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) FROM st
  UNION ALL
  SELECT feature, n, m, edge, t + 1, list_transform(range(0, n + 3), lambda x:
    CASE WHEN x BETWEEN 1 AND n + 1 AND (t + 1) - (x - 1) BETWEEN 0 AND m AND abs((x - 1) * m - ((t + 1) - (x - 1)) * n) < edge
         THEN (gone[x] * (x - 1) + gone[x + 1] * ((t + 1) - (x - 1))) / (t + 1) ELSE 1.0::DOUBLE END)
  FROM walk WHERE t < n + m)"""


@register("ks_exact_customer", f"""WITH RECURSIVE {_KS_SQL}
SELECT w.feature, round(st.statistic, 6) AS statistic, round(gone[w.n + 2], 6) AS p_value, gone[w.n + 2] < 0.05 AS drift_detected
FROM walk w JOIN st USING (feature) WHERE t = w.n + w.m""", ("D1",))
def ks_exact_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of the first twelve nations against the rest, with exact p-values."""
    c = read_table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey")
    counts = drift.numeric_counts(c.where("c_nationkey < 12"), c.where("c_nationkey >= 12"), ["c_acctbal", "c_custkey"])
    tests = drift.ks_from_ladder(value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur"]), ks_pvalue_auto)
    return tests.select("feature", F.round("statistic", R6).alias("statistic"), F.round("p_value", R6).alias("p_value"),
                        (F.col("p_value") < drift.P_VALUE_THRESHOLD).alias("drift_detected"))


#: P(D_n >= d) for n = round(RC / (R + C)): twice the one-sided sum from n d^2 = 2.2 on; below, the limiting
#: distribution and its corrections (samples of the query have more than 140 values).
_FINITE_SQL = """
e AS (SELECT feature, statistic AS d, round(R::DOUBLE * C / (R + C)) AS n FROM ks_d),
tail AS (SELECT feature, any_value(d) * sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
             + (j - 1) * ln(d + j / n) + (n - j) * ln(1 - d - j / n))) * 2 AS p
         FROM (SELECT feature, d, n, unnest(range(0, CAST(floor(n * (1 - d)) AS BIGINT) + 1)) AS j FROM e WHERE n * d * d BETWEEN 2.2 AND 370)
         WHERE 1 - d - j / n > 0 GROUP BY feature),
z AS (SELECT feature, n, sqrt(n) * d AS z, unnest(range(-60, 61)) AS k FROM e WHERE n * d * d < 2.2),
t AS (SELECT feature, n, z, k, pi() * pi() * (k + 0.5) * (k + 0.5) AS h, pi() * pi() * k * k AS w, sqrt(pi() / 2) AS r FROM z),
near AS (SELECT feature, 1 - (
    sum(CASE WHEN k >= 1 THEN sqrt(2 * pi()) / z * exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * z * z)) ELSE 0 END)
  + sum(r / (6 * z ** 4) * (h - z ** 2) * exp(-h / (2 * z ** 2))) / any_value(n) ** 0.5
  + sum(r / (72 * z ** 7) * (6 * z ** 6 + 2 * z ** 4 + h * (2 * z ** 4 - 5 * z ** 2) + h * h * (1 - 2 * z ** 2)) * exp(-h / (2 * z ** 2))
        - r / (36 * z ** 3) * w * exp(-w / (2 * z ** 2))) / any_value(n)
  + sum(r / (6480 * z ** 10) * (h ** 3 * (5 - 30 * z ** 2) + h * h * (212 * z ** 4 - 60 * z ** 2) + h * (135 * z ** 4 - 96 * z ** 6)
          - 30 * z ** 6 - 90 * z ** 8) * exp(-h / (2 * z ** 2))
        + r / (216 * z ** 6) * (3 * w * z ** 2 - w * w) * exp(-w / (2 * z ** 2))) / any_value(n) ** 1.5) AS p
  FROM t GROUP BY feature)"""


@register("ks_finite_lineitem", f"""WITH src AS (SELECT CASE WHEN l_suppkey % 3 = 0 THEN 0 ELSE 1 END AS side, * FROM lineitem),
nl AS (SELECT side, 'l_quantity' AS feature, l_quantity::DOUBLE AS v FROM src
       UNION ALL SELECT side, 'l_extendedprice', l_extendedprice::DOUBLE FROM src
       UNION ALL SELECT side, 'l_partkey', l_partkey::DOUBLE FROM src
       UNION ALL SELECT side, 'l_suppkey', l_suppkey::DOUBLE FROM src),
{O.num_counts('nl', 'nc')}, {O.ladder('nc', 'lad')}, {O.ks('lad', 'ks')},{_FINITE_SQL}
SELECT e.feature, round(e.d, 6) AS statistic, round(p, 6) AS p_value, p < 0.05 AS drift_detected
FROM e LEFT JOIN (SELECT * FROM tail UNION ALL SELECT * FROM near) USING (feature)""", ("D1",))
def ks_finite_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of every third supplier against the rest: samples beyond the exact test, with finite-n p-values."""
    names = ["l_quantity", "l_extendedprice", "l_partkey", "l_suppkey"]
    li = read_table(spark, sf_dir, "lineitem").select(*names)
    counts = drift.numeric_counts(li.where("l_suppkey % 3 = 0"), li.where("l_suppkey % 3 <> 0"), names)
    tests = drift.ks_from_ladder(value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur"]), ks_pvalue_auto)
    return tests.select("feature", F.round("statistic", R6).alias("statistic"), F.round("p_value", R6).alias("p_value"),
                        (F.col("p_value") < drift.P_VALUE_THRESHOLD).alias("drift_detected"))


# ---------------------------------------------------------------- I12 inside M5

@register("model_cv_smote_embeddings", f"""
WITH h AS (SELECT vec_id, (label = 0)::INTEGER AS label, {_hash_sql('vec_id', 42)} AS h FROM embeddings),
f AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY h) - 1) % 5)::INTEGER AS fold FROM h)
SELECT fold, true_label, count(*) AS n, count(*) AS n_in_range FROM (SELECT fold, label AS true_label FROM f) GROUP BY ALL""", ("M5", "I12"))
def model_cv_smote_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-validation with oversampled training folds: every given row is scored once, no synthetic one is."""
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", array_to_vector(F.col("embedding")).alias("features"), (F.col("label") == 0).cast("int").alias("label"))
    rows = M.fold_plan(e, ["vec_id"], "label", 5, 42)

    def make(train: DataFrame):
        return M.logistic("features", "label", "weight", train.agg(F.sum("weight")).first()[0])
    oof, _ = M.cross_validate(rows, make, "label", "fold", ["vec_id"], resample=M.resampler("label", ["vec_id"]))
    return oof.groupBy("fold", "true_label").agg(F.count("*").alias("n"), F.count_if(F.col("probability").between(0, 1)).alias("n_in_range"))
