"""Cleaning and label queries (C1-C21, K1-K6, J1, P1-P5) over sheet-like views
derived from ``orders``, ``customer``, ``lineitem`` and ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import labels as L
from tidewatch.functions import normalize as N
from tidewatch.operators import clean as K
from tidewatch.operators.columns import col
from tidewatch.plans import synth as S
from tidewatch.plans.catalog import register
from tidewatch.sources.tables import read_table

# ---------------------------------------------------------------- SQL twins of the expressions


def _q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _lst(items) -> str:
    return "(" + ", ".join("'" + t.replace("'", "''") + "'" for t in items) + ")"


def yn_sql(x: str) -> str:
    k = f"upper({_strip(x)})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {k} IN {_lst(N.YES_TOKENS)} THEN 'YES' "
            f"WHEN {k} IN {_lst(N.NO_TOKENS)} THEN 'NO' WHEN {k} IN {_lst(N.NULL_TOKENS)} THEN NULL ELSE {x} END)")


def sex_sql(x: str) -> str:
    k = f"upper({_strip(x)})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {k} IN {_lst(N.MALE_TOKENS)} THEN 'M' "
            f"WHEN {k} IN {_lst(N.FEMALE_TOKENS)} THEN 'F' WHEN {k} IN {_lst(N.NULL_TOKENS)} THEN NULL ELSE {x} END)")


def month_sql(x: str) -> str:
    s = f"replace(lower({_strip(x)}), ' ', '')"
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN regexp_matches({s}, '{'|'.join(N.MONTH_SPELLINGS)}') "
            f"AND length({d}) > 0 THEN 'MONTH_' || {d} ELSE {x} END)")


def dbl_sql(x: str) -> str:
    return f"TRY_CAST({x} AS DOUBLE)"


def culture_sql(x: str) -> str:
    s = f"lower({_strip(x)})"
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {s} IN {_lst(L.NEGATIVE_RESULTS)} THEN 0 "
            f"WHEN contains({s}, 'positive') THEN 1 ELSE NULL END)::INTEGER")


def count_yes_sql(cols) -> str:
    return "(" + " + ".join(f"coalesce((upper({_strip(c)}) = 'YES')::INTEGER, 0)" for c in cols) + ")"


# ---------------------------------------------------------------- derived sheets

def patients_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    age_tail = S.pick_col(k, "age", ["", " ", "y", ".5", " yrs"])
    wt_tail = S.pick_col(k, "wt", ["", ".5", "kg", ""])
    ht_tail = S.pick_col(k, "ht", ["", " ", "cm"])
    return o.select(
        k.alias("RECORD"),
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("Sample ID"),
        S.pick_col(k, "sex", S.SEX_POOL).alias("SEX"),
        S.pick_col(k, "smokes", S.YES_NO_POOL).alias("SMOKES"),
        S.pick_col(k, "tbc", S.YES_NO_POOL).alias("TB_CONTACT"),
        S.pick_col(k, "hiv", S.YES_NO_POOL).alias("HIV STATUS"),
        F.concat((F.col("o_custkey") % 70 + 15).cast("string"), age_tail).alias("AGE (YEARS)"),
        F.concat(F.floor(F.col("o_totalprice") / 5000).cast("long").cast("string"), wt_tail).alias("WEIGHT (KG)"),
        F.concat((F.col("o_orderkey") % 50 + 140).cast("string"), ht_tail).alias("HEIGHT (CM)"),
        S.pick_col(k, "m2", S.CULTURE_POOL).alias("2 MONTHS"),
        S.pick_col(k, "m5", S.CULTURE_POOL).alias("5 MONTHS"),
        S.pick_col(k, "conv", S.CONVERSION_POOL).alias("2_MONTHS_RESULT"),
        S.pick_col(k, "base", S.BASELINE_POOL).alias("BASELINE_RESULT"),
    )


def patients_sql() -> str:
    k = "o_orderkey"
    p = lambda salt, pool: S.pick_sql(k, salt, pool)
    return f"""SELECT o_orderkey AS RECORD, 'S' || CAST(o_custkey AS VARCHAR) AS "Sample ID",
  {p('sex', S.SEX_POOL)} AS SEX, {p('smokes', S.YES_NO_POOL)} AS SMOKES, {p('tbc', S.YES_NO_POOL)} AS TB_CONTACT,
  {p('hiv', S.YES_NO_POOL)} AS "HIV STATUS",
  CAST(o_custkey % 70 + 15 AS VARCHAR) || {p('age', ['', ' ', 'y', '.5', ' yrs'])} AS "AGE (YEARS)",
  CAST(CAST(floor(o_totalprice / 5000) AS BIGINT) AS VARCHAR) || {p('wt', ['', '.5', 'kg', ''])} AS "WEIGHT (KG)",
  CAST(o_orderkey % 50 + 140 AS VARCHAR) || {p('ht', ['', ' ', 'cm'])} AS "HEIGHT (CM)",
  {p('m2', S.CULTURE_POOL)} AS "2 MONTHS", {p('m5', S.CULTURE_POOL)} AS "5 MONTHS",
  {p('conv', S.CONVERSION_POOL)} AS "2_MONTHS_RESULT", {p('base', S.BASELINE_POOL)} AS BASELINE_RESULT
FROM orders"""


def demographics_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(F.concat(F.lit("S"), k.cast("string")).alias("Sample ID"),
                    *[S.pick_col(k, "d_" + s, S.YES_NO_POOL).alias(s) for s in K.DEMO_SYMPTOMS])


def demographics_sql() -> str:
    cols = ", ".join(f"{S.pick_sql('c_custkey', 'd_' + s, S.YES_NO_POOL)} AS {_q(s)}" for s in K.DEMO_SYMPTOMS)
    return f"""SELECT 'S' || CAST(c_custkey AS VARCHAR) AS "Sample ID", {cols} FROM customer"""


def contacts_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.alias("RECORD"), S.pick_col(k, "c_sex", S.SEX_POOL).alias("SEX"),
        *[S.pick_col(k, "c_" + s, S.YES_NO_POOL).alias(s) for s in K.FOLLOWUP_SYMPTOMS],
        S.pick_col(k, "c_hiv", S.YES_NO_POOL).alias("HIV STATUS"),
        F.concat((k % 60 + 18).cast("string"), S.pick_col(k, "c_age", ["", " ", "?"])).alias("AGE"),
        F.floor(F.col("c_acctbal") / 100).cast("long").cast("string").alias("WEIGHT"))


def contacts_sql() -> str:
    p = lambda salt, pool: S.pick_sql("c_custkey", salt, pool)
    syms = ", ".join(f"{p('c_' + s, S.YES_NO_POOL)} AS {_q(s)}" for s in K.FOLLOWUP_SYMPTOMS)
    return f"""SELECT c_custkey AS RECORD, {p('c_sex', S.SEX_POOL)} AS SEX, {syms},
  {p('c_hiv', S.YES_NO_POOL)} AS "HIV STATUS",
  CAST(c_custkey % 60 + 18 AS VARCHAR) || {p('c_age', ['', ' ', '?'])} AS AGE,
  CAST(CAST(floor(c_acctbal / 100) AS BIGINT) AS VARCHAR) AS WEIGHT FROM customer"""


# ---------------------------------------------------------------- queries

NORMALIZE_ORACLE = f"""
WITH src AS (
  SELECT o_orderkey,
    {S.pick_sql('o_orderkey', 'yn', S.YES_NO_POOL)} AS raw_yn,
    {S.pick_sql('o_orderkey', 'sx', S.SEX_POOL)} AS raw_sex,
    {S.pick_sql('o_orderkey', 'mo', S.MONTH_POOL)} || o_orderpriority AS raw_month,
    CAST(o_custkey AS VARCHAR) || {S.pick_sql('o_orderkey', 'nm', ['', ' ', '.25', 'x', ''])} AS raw_num,
    {S.pick_sql('o_orderkey', 'vv', ['v3', 'v10', 'V9', 'version 12', 'latest', None, 'v0', 'beta'])} AS raw_version,
    o_totalprice
  FROM orders)
SELECT o_orderkey, {yn_sql('raw_yn')} AS yes_no, {sex_sql('raw_sex')} AS sex, {month_sql('raw_month')} AS month,
  {dbl_sql('raw_num')} AS num,
  coalesce(CASE WHEN regexp_extract(raw_version, '\\d+', 0) <> '' THEN TRY_CAST(regexp_extract(raw_version, '\\d+', 0) AS INTEGER) END, 0) AS version,
  CAST(least(greatest(round_even(o_totalprice / 300000.0 - 0.2, 0), 0.0), 1.0) AS INTEGER) AS flag,
  coalesce(TRY_CAST(raw_num AS DOUBLE), CASE WHEN raw_num IS NULL THEN 0.0 END) AS export_num,
  CASE WHEN raw_num IS NOT NULL AND TRY_CAST(raw_num AS DOUBLE) IS NULL THEN raw_num END AS export_text
FROM src"""


@register("clean_normalize_orders", NORMALIZE_ORACLE, ("C1", "C2", "C3", "C4", "C16", "C19", "C21"))
def clean_normalize_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    src = o.select(
        "o_orderkey", "o_totalprice",
        S.pick_col(k, "yn", S.YES_NO_POOL).alias("raw_yn"),
        S.pick_col(k, "sx", S.SEX_POOL).alias("raw_sex"),
        F.concat(S.pick_col(k, "mo", S.MONTH_POOL), F.col("o_orderpriority")).alias("raw_month"),
        F.concat(F.col("o_custkey").cast("string"), S.pick_col(k, "nm", ["", " ", ".25", "x", ""])).alias("raw_num"),
        S.pick_col(k, "vv", ["v3", "v10", "V9", "version 12", "latest", None, "v0", "beta"]).alias("raw_version"))
    return src.select(
        "o_orderkey", N.yes_no(F.col("raw_yn")).alias("yes_no"), N.sex(F.col("raw_sex")).alias("sex"),
        N.followup_month(F.col("raw_month")).alias("month"), N.safe_double(F.col("raw_num")).alias("num"),
        N.version_number(F.col("raw_version")).alias("version"),
        N.clip_round_flag(F.col("o_totalprice") / 300000.0 - 0.2).alias("flag"),
        N.export_number(F.col("raw_num")).alias("export_num"), N.export_text(F.col("raw_num")).alias("export_text"))


JSON_TEMPLATES = ["{J}", "```json\n{J}\n```", "Sure! Here it is: {J} Hope it helps.", "[{J}, {J}]", "no json here",
                  "```\n{J}\n```", "{\"broken\": {J}", "prefix [{J}] suffix"]

JSON_ORACLE = f"""
WITH src AS (
  SELECT event_id, replace({S.pick_sql('event_id', 'tpl', JSON_TEMPLATES)}, '{{J}}', props) AS raw FROM events),
a AS (SELECT event_id, {_strip('raw')} AS r FROM src),
b AS (SELECT event_id, CASE WHEN starts_with(r, '```') THEN split_part(r, '```', 2) ELSE r END AS f FROM a),
c AS (SELECT event_id, {_strip("CASE WHEN starts_with(f, 'json') THEN substr(f, 5) ELSE f END")} AS body FROM b),
d AS (SELECT event_id, body, regexp_extract(body, '\\{{.*\\}}', 0, 's') AS brace, regexp_extract(body, '\\[.*\\]', 0, 's') AS bracket FROM c),
e AS (SELECT event_id,
        coalesce(CASE WHEN json_valid(body) THEN body END,
                 CASE WHEN brace <> '' AND json_valid(brace) THEN brace END,
                 CASE WHEN bracket <> '' AND json_valid(bracket) THEN json_extract(bracket, '$[0]')::VARCHAR END) AS found FROM d)
SELECT event_id, TRY_CAST(json_extract_string(found, '$.k') AS BIGINT) AS k,
       coalesce(json_type(found) = 'OBJECT'
                AND (json_extract(found, '$.value') IS NULL OR (json_type(json_extract(found, '$.value')) = 'OBJECT' AND json_extract(found, '$.value.mean') IS NOT NULL))
                AND (json_extract(found, '$.event_type') IS NULL OR (json_type(json_extract(found, '$.event_type')) = 'OBJECT' AND json_extract(found, '$.event_type.distribution') IS NOT NULL)), false) AS valid
FROM e"""


@register("clean_json_salvage", JSON_ORACLE, ("C17", "C18"))
def clean_json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events")
    tpl = S.pick_col(F.col("event_id"), "tpl", JSON_TEMPLATES)
    raw = F.replace(tpl, F.lit("{J}"), F.col("props"))
    found = N.salvage_json(raw)
    return ev.select("event_id", found.alias("found")).select(
        "event_id", F.get_json_object("found", "$.k").try_cast("long").alias("k"),
        N.has_fields(F.col("found"), ["value"], ["event_type"]).alias("valid"))


AIM1_COLS = ["RECORD", "Sample ID", "SEX", "SMOKES", "TB_CONTACT", "HIV STATUS", "AGE (YEARS)", "WEIGHT (KG)",
             "HEIGHT (CM)", "COUGH", "HEMOPTYSIS", "TARGET_NON_CONVERSION_2M", "TARGET_NON_CONVERSION_5M",
             "TARGET_NON_CONVERSION_ANY", "IS_IMPUTED", "BASELINE_POSITIVE"]


def _aim1_base_sql() -> str:
    syms = ", ".join(f"{yn_sql(_q(s))} AS {_q(s)}" for s in K.DEMO_SYMPTOMS)
    return f"""p AS ({patients_sql()}),
pc AS (SELECT RECORD, "Sample ID", {sex_sql('SEX')} AS SEX, {yn_sql('SMOKES')} AS SMOKES,
          {yn_sql('TB_CONTACT')} AS TB_CONTACT, {yn_sql('"HIV STATUS"')} AS "HIV STATUS",
          {dbl_sql('"AGE (YEARS)"')} AS "AGE (YEARS)", {dbl_sql('"WEIGHT (KG)"')} AS "WEIGHT (KG)",
          {dbl_sql('"HEIGHT (CM)"')} AS "HEIGHT (CM)", "2 MONTHS", "5 MONTHS", "2_MONTHS_RESULT", BASELINE_RESULT FROM p),
d AS (SELECT "Sample ID", {syms} FROM ({demographics_sql()})),
m AS (SELECT pc.*, {', '.join('d.' + _q(s) for s in K.DEMO_SYMPTOMS)} FROM pc LEFT JOIN d ON pc."Sample ID" = d."Sample ID")"""


AIM1_ORACLE = f"""
WITH {_aim1_base_sql()},
l AS (SELECT *, {culture_sql('"2 MONTHS"')} AS TARGET_NON_CONVERSION_2M, {culture_sql('"5 MONTHS"')} AS TARGET_NON_CONVERSION_5M FROM m)
SELECT RECORD, "Sample ID", SEX, SMOKES, TB_CONTACT, "HIV STATUS", "AGE (YEARS)", "WEIGHT (KG)", "HEIGHT (CM)", COUGH, HEMOPTYSIS,
  TARGET_NON_CONVERSION_2M, TARGET_NON_CONVERSION_5M,
  coalesce(greatest(TARGET_NON_CONVERSION_2M, TARGET_NON_CONVERSION_5M), 0)::INTEGER AS TARGET_NON_CONVERSION_ANY,
  (TARGET_NON_CONVERSION_2M IS NULL AND TARGET_NON_CONVERSION_5M IS NULL)::INTEGER AS IS_IMPUTED,
  CASE WHEN BASELINE_RESULT IS NOT NULL THEN contains(BASELINE_RESULT, 'Positive')::INTEGER END AS BASELINE_POSITIVE
FROM l"""


@register("clean_aim1_imputed_labels", AIM1_ORACLE, ("K1", "K4", "J1", "C4", "C5", "C6", "C10", "C11", "P2"))
def clean_aim1_imputed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.imputed_label_dataset(patients_view(spark, sf_dir), demographics_view(spark, sf_dir))
    return df.select(*[col(c) for c in AIM1_COLS])


STRICT_COLS = ["RECORD", "Sample ID", "TARGET_STRICT_M2", "baseline_symptom_count", "M2_DISCORDANT", "IS_IMPUTED",
               "BASELINE_POSITIVE"]

STRICT_ORACLE = f"""
WITH {_aim1_base_sql()}
SELECT RECORD, "Sample ID", {culture_sql('"2 MONTHS"')} AS TARGET_STRICT_M2,
  {count_yes_sql([_q(s) for s in K.DEMO_SYMPTOMS])} AS baseline_symptom_count,
  CASE WHEN "2 MONTHS" IS NOT NULL AND "2_MONTHS_RESULT" IS NOT NULL THEN
    (contains(lower({_strip('"2 MONTHS"')}), 'positive') <> (lower({_strip('"2_MONTHS_RESULT"')}) = 'no conversion'))::INTEGER
    ELSE 0 END AS M2_DISCORDANT,
  ("2 MONTHS" IS NULL)::INTEGER AS IS_IMPUTED,
  CASE WHEN BASELINE_RESULT IS NOT NULL THEN contains(BASELINE_RESULT, 'Positive')::INTEGER END AS BASELINE_POSITIVE
FROM m"""


@register("clean_aim1_strict_labels", STRICT_ORACLE, ("K5", "C8", "C12", "C13"))
def clean_aim1_strict_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.strict_label_dataset(patients_view(spark, sf_dir), demographics_view(spark, sf_dir))
    return df.select(*[col(c) for c in STRICT_COLS])


CONTACT_ORACLE = f"""
WITH c AS ({contacts_sql()}),
cc AS (SELECT RECORD, {sex_sql('SEX')} AS SEX, {', '.join(yn_sql(_q(s)) + ' AS ' + _q(s) for s in K.FOLLOWUP_SYMPTOMS)},
         {yn_sql('"HIV STATUS"')} AS "HIV STATUS", {dbl_sql('AGE')} AS AGE, {dbl_sql('WEIGHT')} AS WEIGHT FROM c),
f AS (SELECT *, {', '.join(f"coalesce(({_q(s)} = 'YES')::INTEGER, 0) AS {_q(s + '_BINARY')}" for s in K.FOLLOWUP_SYMPTOMS)} FROM cc)
SELECT *, least(greatest({' + '.join(_q(s + '_BINARY') for s in K.FOLLOWUP_SYMPTOMS)}, 0), 1)::INTEGER AS TARGET_SYMPTOM_PRESENT FROM f"""


@register("clean_contacts_labels", CONTACT_ORACLE, ("K3", "K6", "C2", "C7", "C9"))
def clean_contacts_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.contact_dataset(contacts_view(spark, sf_dir))


FOLLOWUP_ORACLE = f"""
WITH f AS (
  SELECT l_orderkey, l_linenumber,
    {S.pick_sql("l_orderkey * 8 + l_linenumber", 'fm', S.MONTH_POOL)} || CAST(l_linenumber AS VARCHAR) AS "FOLLOW UP MONTH",
    {S.pick_sql("l_orderkey * 8 + l_linenumber", 'fc', S.YES_NO_POOL)} AS COUGH,
    {S.pick_sql("l_orderkey * 8 + l_linenumber", 'fd', S.YES_NO_POOL)} AS DYSPNEA,
    CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || {S.pick_sql("l_orderkey * 8 + l_linenumber", 'fa', ['', 'y', ' '])} AS AGE
  FROM lineitem)
SELECT l_orderkey, l_linenumber, {month_sql('"FOLLOW UP MONTH"')} AS "FOLLOW UP MONTH", {yn_sql('COUGH')} AS COUGH,
       {yn_sql('DYSPNEA')} AS DYSPNEA, {dbl_sql('AGE')} AS AGE FROM f"""


@register("clean_followup", FOLLOWUP_ORACLE, ("K2", "C1", "C3", "C4"))
def clean_followup(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    f = li.select(
        "l_orderkey", "l_linenumber",
        F.concat(S.pick_col(key, "fm", S.MONTH_POOL), F.col("l_linenumber").cast("string")).alias("FOLLOW UP MONTH"),
        S.pick_col(key, "fc", S.YES_NO_POOL).alias("COUGH"),
        S.pick_col(key, "fd", S.YES_NO_POOL).alias("DYSPNEA"),
        F.concat(F.col("l_quantity").cast("long").cast("string"), S.pick_col(key, "fa", ["", "y", " "])).alias("AGE"))
    return K.clean_followup(f)


BMI_ORACLE = f"""
WITH p AS ({patients_sql()})
SELECT RECORD,
  CASE WHEN isfinite(TRY_CAST("WEIGHT (KG)" AS DOUBLE) / ((TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0) * (TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0)))
       THEN round(TRY_CAST("WEIGHT (KG)" AS DOUBLE) / ((TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0) * (TRY_CAST("HEIGHT (CM)" AS DOUBLE) / 100.0)), 6) END AS BMI_CALCULATED
FROM p"""


@register("clean_bmi", BMI_ORACLE, ("C14",))
def clean_bmi(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = K.with_bmi(patients_view(spark, sf_dir))
    return df.select("RECORD", F.round("BMI_CALCULATED", 6).alias("BMI_CALCULATED"))


J1_SQL = """
WITH l AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'S' || CAST(o_custkey AS VARCHAR) END AS "Sample ID",
                  o_orderstatus AS STATUS FROM orders),
r AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 'S' || CAST(c_custkey - c_custkey % 2 AS VARCHAR) END AS "Sample ID",
             c_mktsegment AS STATUS, c_nationkey AS NATION FROM customer)
SELECT l.o_orderkey, l."Sample ID", l.STATUS AS STATUS_x, r.STATUS AS STATUS_y, r.NATION FROM l LEFT JOIN r USING ("Sample ID")"""


@register("clean_join_null_and_duplicate_keys", J1_SQL, ("J1",))
def clean_join_null_and_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides have null keys, and the right side repeated ones."""
    o, c = read_table(spark, sf_dir, "orders"), read_table(spark, sf_dir, "customer")
    left = o.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("S"), F.col("o_custkey").cast("string"))).alias("Sample ID"),
                    F.col("o_orderstatus").alias("STATUS"))
    pair = (F.col("c_custkey") - F.col("c_custkey") % 2).cast("string")
    right = c.select(F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("S"), pair)).alias("Sample ID"),
                     F.col("c_mktsegment").alias("STATUS"), F.col("c_nationkey").alias("NATION"))
    return K.left_join_suffixed(left, right, "Sample ID")


@register("reindex_part", """
SELECT p_partkey, NULL::DOUBLE AS p_weight, p_brand, NULL::VARCHAR AS p_comment FROM part""", ("P3",))
def reindex_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed column list with two columns that the table lacks."""
    from tidewatch.operators.columns import reindex
    return reindex(read_table(spark, sf_dir, "part"), ["p_partkey", "p_weight", "p_brand", "p_comment"], {"p_comment": "string"})
