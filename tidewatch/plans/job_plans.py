"""Job-level queries: profiles with the drift-feature gate, key findings,
fixed-feature drift checks, multi-aim monitoring, variant writing, the gated
training job, the champion report and background summaries
(A13, P4, P5, P8, P10, P11, D14, D15, G4, M13, X10, I15)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import attribution as X
from tidewatch.operators import drift as D
from tidewatch.operators import inject as G
from tidewatch.operators import model_drift as MD
from tidewatch.operators import profile as A
from tidewatch.operators.columns import attach_row, coalesce_aliases, col, is_numeric_type, skip_by_prefix
from tidewatch.plans import attribution_plans as XP
from tidewatch.plans import clean_plans as CP
from tidewatch.plans.catalog import SLOW, register
from tidewatch.plans.inject_plans import patients_features
from tidewatch.plans.sink_plans import scratch
from tidewatch.sources import sinks as SK
from tidewatch.sources.tables import read_table

R6 = 6
# Identifier columns left out of a reference profile, and the
# drift-feature gate (prefix, exact names, largest category count).
ID_COLUMNS = ["Sample ID", "USUBJID", "SUBJID", "PATIENT_ID", "STUDY_ID"]
DRIFT_SKIP_PREFIXES = ("TARGET_",)
DRIFT_SKIP_EXACT = ["IS_IMPUTED", "SOURCE", "DRUG/REGIMEN", "BASELINE", "TREATMENT OUTCOME", "HIGHEST LEVEL OF EDUCATION",
                    "HIGHEST LEVEL OF EDUCATION (None/Primary/Secondary/Higher[S5/6]/Tertiary)", "OCCUPATION/WORK",
                    "IF_YES_WHEN", "TREATED_FOR_TB", "RISK FACTORS", "COMOBIDITIES", "COMPLICATIONS OF A TB PATIENT"]
DRIFT_MAX_CATEGORIES = 15


def profile_columns(df: DataFrame) -> list[str]:
    """P10: every column except 'Unnamed*' headers and identifier columns."""
    return [c for c in skip_by_prefix(df.columns, ("Unnamed",), ID_COLUMNS)]


def drift_feature_gate(profile_types: DataFrame) -> DataFrame:
    """P8 on a (feature, type, n_categories) table: drop the TARGET_ prefix, the
    listed names and categorical features with more than 15 categories."""
    prefix = F.lit(False)
    for p in DRIFT_SKIP_PREFIXES:
        prefix = prefix | F.col("feature").startswith(p)
    too_many = (F.col("type") == "categorical") & (F.col("n_categories") > DRIFT_MAX_CATEGORIES)
    return profile_types.withColumn("kept", ~(prefix | F.col("feature").isin(DRIFT_SKIP_EXACT) | too_many))


@register("reference_profile_gate", None, ("A1", "A2", "P8", "P10"))
def reference_profile_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference profile of the cleaned patients (numeric stats and category shares)
    and the drift-feature gate applied to it; one row per feature."""
    # the derived view feeds the moments, the quantile ladder and the category
    # counts; computing it once saves re-running its hashing and cleaning
    from tidewatch.session import cut_lineage
    pf = cut_lineage(patients_features(spark, sf_dir))
    cols = profile_columns(pf)
    types = {f.name: f.dataType for f in pf.schema.fields}
    num = [c for c in cols if is_numeric_type(types[c])]
    cat = [c for c in cols if c not in num]
    nprof = A.numeric_profile(pf, num).select("feature", F.lit("numeric").alias("type"),
                                             F.lit(None).cast("long").alias("n_categories"),
                                             *[F.round(c, R6).alias(c) for c in ("mean", "std", "min", "max", "q25", "q50", "q75")])
    cprof = (A.categorical_profile(pf, cat).groupBy("feature")
             .agg(F.count(F.lit(1)).alias("n_categories"), F.max("share").alias("top_share"))
             .select("feature", F.lit("categorical").alias("type"), "n_categories", F.round("top_share", R6).alias("top_share")))
    return drift_feature_gate(nprof.unionByName(cprof, allowMissingColumns=True))


@register("key_findings", f"""
WITH p AS ({CP.AIM1_ORACLE}), k AS ({CP.CONTACT_ORACLE}), f AS ({CP.FOLLOWUP_ORACLE})
SELECT (SELECT count(*) FROM p) AS total_patients, (SELECT round(avg("AGE (YEARS)"), 6) FROM p) AS mean_age,
  (SELECT round(avg((SEX = 'M')::DOUBLE) * 100, 6) FROM p) AS male_pct,
  (SELECT round(avg(coalesce("HIV STATUS" = 'YES', false)::DOUBLE) * 100, 6) FROM p) AS hiv_positive_pct,
  (SELECT count(*) FILTER (WHERE BASELINE_POSITIVE = 1) FROM p) AS baseline_positive,
  (SELECT count(TARGET_NON_CONVERSION_2M) FROM p) AS month2_labels, (SELECT count(TARGET_NON_CONVERSION_5M) FROM p) AS month5_labels,
  (SELECT count(*) FROM k) AS contacts, (SELECT sum(TARGET_SYMPTOM_PRESENT) FROM k) AS contacts_with_symptoms,
  (SELECT count(*) FROM f) AS followup_visits""", ("A13",))
def key_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of headline numbers over the three cleaned tables (one aggregate each)."""
    p = CP.clean_aim1_imputed_labels(spark, sf_dir)
    k = CP.clean_contacts_labels(spark, sf_dir)
    f = CP.clean_followup(spark, sf_dir)
    a = p.agg(F.count(F.lit(1)).alias("total_patients"), F.round(F.avg(col("AGE (YEARS)")), R6).alias("mean_age"),
              F.round(F.avg((F.col("SEX") == "M").cast("double")) * 100, R6).alias("male_pct"),
              F.round(F.avg(F.coalesce(col("HIV STATUS") == "YES", F.lit(False)).cast("double")) * 100, R6).alias("hiv_positive_pct"),
              F.count_if(F.col("BASELINE_POSITIVE") == 1).alias("baseline_positive"),
              F.count("TARGET_NON_CONVERSION_2M").alias("month2_labels"), F.count("TARGET_NON_CONVERSION_5M").alias("month5_labels"))
    b = k.agg(F.count(F.lit(1)).alias("contacts"), F.sum("TARGET_SYMPTOM_PRESENT").cast("long").alias("contacts_with_symptoms"))
    c = f.agg(F.count(F.lit(1)).alias("followup_visits"))
    return attach_row(attach_row(a, b), c)


@register("training_rows_documents", """
SELECT d.doc_id, d.lang, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND d.lang IN ('en', 'de')""", ("P4", "P5", "P2"))
def training_rows_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = d.join(read_table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.where(F.col("quality").isNotNull() & F.col("lang").isin("en", "de"))


@register("api_alias_mapping", f"""
WITH p AS ({CP.patients_sql()})
SELECT RECORD, coalesce((o_custkey_mod)::DOUBLE, TRY_CAST("AGE (YEARS)" AS DOUBLE)) AS "AGE (YEARS)", SEX FROM
  (SELECT p.*, CASE WHEN RECORD % 3 = 0 THEN NULL ELSE (RECORD % 5)::BIGINT END AS o_custkey_mod FROM p)""", ("P11",))
def api_alias_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request rows with an API-named ``age`` (zeros kept, nulls fall back) mapped onto
    the model column name."""
    p = CP.patients_view(spark, sf_dir)
    req = p.select("RECORD", F.when(F.col("RECORD") % 3 == 0, F.lit(None)).otherwise(F.col("RECORD") % 5).alias("age"),
                   col("AGE (YEARS)").try_cast("double").alias("AGE (YEARS)"), "SEX")
    return coalesce_aliases(req, {"age": "AGE (YEARS)"}).select("RECORD", col("AGE (YEARS)").cast("double").alias("AGE (YEARS)"), "SEX")


def _d14_sql() -> str:
    from tidewatch.plans.drift_plans import ORD_SRC, _oracle
    return f"""
WITH t AS ({_oracle(ORD_SRC, {'o_totalprice': 'o_totalprice'}, {'o_orderpriority': 'o_orderpriority'})}),
f AS (SELECT feature, bool_or(drift_detected) AS d, any_value(feature_type) AS ft FROM t GROUP BY feature)
SELECT count_if(d) / 2.0 > 0.3 AS data_drift_detected, round(count_if(d) / 2.0, 6) AS drift_ratio, 2::BIGINT AS n_features,
       any_value(ft) FILTER (WHERE feature = 'o_totalprice') AS o_totalprice_type FROM f"""


@register("drift_check_job_orders", _d14_sql(), ("D14", "S10", "D8"))
def drift_check_job_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-feature drift check: orders before 2000 against later ones on two
    features, nested report written as JSON and read back."""
    from tidewatch.plans.drift_plans import ORD_CAT, ORD_NUM, _split
    ref, cur = _split(spark, sf_dir, "orders", "o_orderdate", "2000-01-01", ORD_NUM, ORD_CAT)
    rep = D.data_drift(ref, cur, ["o_totalprice", "o_orderpriority"])
    path = scratch(spark, "drift-report")
    SK.write_table(SK.report_json(D.nested_report(rep), "2000-01-01 00:00:00"), path, fmt="json")
    back = spark.read.schema("ts timestamp, report string").json(path)
    return back.select(F.get_json_object("report", "$.data_drift_detected").cast("boolean").alias("data_drift_detected"),
                       F.round(F.get_json_object("report", "$.drift_ratio").cast("double"), R6).alias("drift_ratio"),
                       F.get_json_object("report", "$.n_features").cast("long").alias("n_features"),
                       F.get_json_object("report", "$.per_feature.o_totalprice.feature_type").alias("o_totalprice_type"))


def _d15_sql() -> str:
    from tidewatch.plans.drift_plans import _oracle
    from tidewatch.plans.window_plans import BASE_SQL, CUT, MODEL_SQL
    data_src = f"SELECT CASE WHEN ts < TIMESTAMP '{CUT}' THEN 0 ELSE 1 END AS side, value, k FROM ({BASE_SQL})"
    data = f"""WITH t AS ({_oracle(data_src, {'value': 'value', 'k': 'k'}, {})}),
f AS (SELECT feature, bool_or(drift_detected) AS d FROM t GROUP BY feature)
SELECT count_if(d) / 2.0 > 0.3 AS data_drift_detected, count_if(d) / 2.0 AS drift_ratio FROM f"""
    parts = []
    for aim in ("purchase", "error"):
        m = (MODEL_SQL.replace("(event_type = 'purchase')", f"(event_type = '{aim}')")
             .replace("strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S')", "'all'"))
        parts.append(f"""SELECT '{aim}' AS aim, d.data_drift_detected, d.drift_ratio, m.model_drift_detected, m.auc_drop,
  d.data_drift_detected OR m.model_drift_detected AS any_drift, false AS retrain FROM ({data}) d, ({m}) m""")
    return "\nUNION ALL\n".join(parts)


@register("monitoring_job_events", _d15_sql(), ("D15", "D12", "D13"))
def monitoring_job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring over several aims: for each target event type, data drift of the
    features and model drift of a fixed score, combined into one verdict row."""
    from tidewatch.plans.window_plans import CUT, SCORE_B, SCORE_W, events_features
    from tidewatch.operators.scoring import logistic_score
    ev = events_features(spark, sf_dir)
    cut = F.lit(CUT).cast("timestamp")
    ref, cur = ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)
    data = D.data_drift(ref, cur, ["value", "k"]).summary
    rows = None
    for aim in ("purchase", "error"):
        lab = lambda d: logistic_score(d.withColumn("label", (F.col("event_type") == aim).cast("int")), SCORE_W, SCORE_B, digits=12)
        m = MD.model_drift(lab(ref), lab(cur), "label").select(F.lit(aim).alias("aim"), "auc_drop", "prediction_psi",
                                                               "model_drift_detected")
        r = MD.combine_reports(data, m).select("aim", "data_drift_detected", "drift_ratio", "model_drift_detected",
                                               F.round("auc_drop", R6).alias("auc_drop"), "any_drift",
                                               MD.should_retrain(F.col("any_drift"), log_only=True).alias("retrain"))
        rows = r if rows is None else rows.unionByName(r)
    return rows


@register("synthetic_variants_customer", """
SELECT 'gaussian' AS variant, count(*) AS n_rows FROM customer UNION ALL SELECT 'swap', count(*) FROM customer
UNION ALL SELECT 'combined', count(*) FROM customer""", ("G4", "S8"))
def synthetic_variants_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three drift variants of a table written side by side and counted back."""
    c = read_table(spark, sf_dir, "customer")
    base = scratch(spark, "variants")
    out = None
    for name, df in (("gaussian", G.gaussian_drift(c, ["c_custkey"])), ("swap", G.category_swap(c, ["c_custkey"])),
                     ("combined", G.combined_drift(c, ["c_custkey"]))):
        SK.write_table(df, f"{base}/{name}")
        r = spark.read.parquet(f"{base}/{name}").agg(F.lit(name).alias("variant"), F.count(F.lit(1)).alias("n_rows"))
        out = r if out is None else out.unionByName(r)
    return out


@register("training_job_gate", None, ("M13", "A18", "A21"))
def training_job_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train only when the data fingerprint changed: the first run trains (no stored
    state), the second sees the stored fingerprint and skips."""
    from tidewatch.operators import models as M
    from tidewatch.plans.model_plans import _lr_maker, embeddings_frame
    emb = read_table(spark, sf_dir, "embeddings")
    state_path = scratch(spark, "train-state")
    results = []
    for run in (1, 2):
        fp = A.fingerprint(emb)
        try:
            stored = spark.read.parquet(state_path)
        except Exception:  # noqa: BLE001 - no state yet
            stored = spark.createDataFrame([], "n_rows long, fingerprint string")
        changed = A.changed_since(fp, stored).collect()[0].changed  # one row
        if changed:
            df = M.balanced_weight(embeddings_frame(spark, sf_dir), "label")
            oof, per_fold = M.cross_validate(df, _lr_maker(), "label", "fold", ["vec_id"])
            auc = per_fold.agg(F.avg("auc")).collect()[0][0]
            SK.write_table(fp, state_path)
            results.append((run, "trained", float(auc)))
        else:
            results.append((run, "skipped", None))
    return spark.createDataFrame(results, "run int, action string, cv_auc_mean double")


SLOW.add("training_job_gate")


@register("champion_report_lineitem", f"""{XP.PHI_SQL},
f AS (SELECT rid, l_orderkey, l_linenumber, feature, sum(phi) AS phi FROM p JOIN {XP.SLOT_MAP_SQL} USING (slot) GROUP BY ALL),
g AS (SELECT feature, avg(abs(phi)) AS mean_abs FROM f GROUP BY feature),
k AS (SELECT min(l_orderkey) AS ok FROM lineitem),
i AS (SELECT feature, phi FROM f, k WHERE f.l_orderkey = k.ok AND f.l_linenumber = (SELECT min(l_linenumber) FROM lineitem, k WHERE l_orderkey = k.ok))
SELECT 'global' AS section, feature, round(mean_abs, 6) AS value FROM g
UNION ALL SELECT 'rank', feature, row_number() OVER (ORDER BY mean_abs DESC, feature)::DOUBLE FROM g
UNION ALL SELECT 'instance', feature, round(sum(phi), 6) FROM i GROUP BY feature
UNION ALL SELECT 'base', 'base_value', round(base_value, 6) FROM b""", ("X10", "X4", "X3", "X6"))
def champion_report_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report tables of one model: global importance, rank, the order
    lines of the first key (their attributions added) and the base value, as (section, feature, value)."""
    rows, base = XP.li_rows(spark, sf_dir)
    folded = X.exploded(X.fold_slots(rows, XP.SLOT_FEATURE))
    g = folded.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    ranked = X.ranked_importance(g, 20)
    li = read_table(spark, sf_dir, "lineitem")
    first = li.agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("k")).select("k.*")
    inst = folded.join(first, ["l_orderkey", "l_linenumber"]).groupBy("feature").agg(F.sum("phi").alias("phi"))
    return (g.select(F.lit("global").alias("section"), "feature", F.round("mean_abs", R6).alias("value"))
            .unionByName(ranked.select(F.lit("rank").alias("section"), "feature", F.col("rank").cast("double").alias("value")))
            .unionByName(inst.select(F.lit("instance").alias("section"), "feature", F.round("phi", R6).alias("value")))
            .unionByName(base.select(F.lit("base").alias("section"), F.lit("base_value").alias("feature"),
                                     F.round("base_value", R6).alias("value"))))


@register("background_kmeans_embeddings", None, ("I15",))
def background_kmeans_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means centres of the embeddings as a weighted background (weight = cluster size)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model = KMeans(k=10, seed=42, featuresCol="features").fit(e)
    sizes = model.transform(e).groupBy("prediction").agg(F.count(F.lit(1)).alias("weight"))
    centers = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(model.clusterCenters())],
                                    "prediction int, center array<double>")  # k rows
    return centers.join(sizes, "prediction").select(F.col("prediction").alias("cluster"), "weight", "center")
