"""Feature matrix, split, fold and attribution queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import attribution as X
from tidewatch.operators import features as FT
from tidewatch.plans.catalog import register
from tidewatch.plans.profile_plans import DOC_LABELS, _doc_labels
from tidewatch.sources.tables import read_table

R6 = 6
DOC_FEATURES = ["n_chars", "quality", "lang", "toxic_text"]


def _r(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, R6).alias(c) if c in cols else F.col(c) for c in df.columns])


def doc_matrix(spark, sf_dir):
    d = _doc_labels(spark, sf_dir)
    pre = FT.fit_preprocessor(d, DOC_FEATURES)
    return pre, FT.transform(pre, d, keep=["doc_id"])


MATRIX_SQL = f"""
WITH j AS ({DOC_LABELS}),
m AS (SELECT quantile_cont(n_chars::DOUBLE, 0.5) AS mn, quantile_cont(quality::DOUBLE, 0.5) AS mq,
             (SELECT arg_min(lang, (-n, lang)) FROM (SELECT lang, count(*) AS n FROM j WHERE lang IS NOT NULL GROUP BY ALL)) AS ml FROM j),
f AS (SELECT j.doc_id, coalesce(j.n_chars::DOUBLE, m.mn) AS n_chars, coalesce(j.quality::DOUBLE, m.mq) AS quality,
             coalesce(j.lang, m.ml) AS lang, coalesce(j.toxic_text, 'NO') AS toxic_text FROM j, m),
s AS (SELECT avg(n_chars) AS a1, stddev_pop(n_chars) AS s1, avg(quality) AS a2, stddev_pop(quality) AS s2 FROM f)
SELECT doc_id,
  round(CASE WHEN s1 > 0 THEN (n_chars - a1) / s1 ELSE n_chars - a1 END, 6) AS n_chars,
  round(CASE WHEN s2 > 0 THEN (quality - a2) / s2 ELSE quality - a2 END, 6) AS quality,
  (lang = 'de')::DOUBLE AS lang_de, (lang = 'en')::DOUBLE AS lang_en, (lang = 'es')::DOUBLE AS lang_es, (lang = 'fr')::DOUBLE AS lang_fr,
  (toxic_text = 'NO')::DOUBLE AS toxic_text_NO, (toxic_text = 'clean')::DOUBLE AS toxic_text_clean,
  (toxic_text = 'toxic')::DOUBLE AS toxic_text_toxic
FROM f, s"""


@register("features_document_matrix", MATRIX_SQL, ("I3", "I4", "I5", "I6", "I7", "I8", "I10", "I11"))
def features_document_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, m = doc_matrix(spark, sf_dir)
    return _r(m, ["n_chars", "quality"])


@register("features_sparse_lineitem", """
WITH src AS (SELECT *, l_orderkey || '-' || l_linenumber AS line, strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
m AS (SELECT avg(l_quantity) AS mean, stddev_pop(l_quantity) AS std FROM src),
l AS (SELECT DISTINCT line, dense_rank() OVER (ORDER BY line) AS slot FROM src),
c AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS slot FROM (SELECT DISTINCT month FROM src)),
n AS (SELECT (SELECT count(DISTINCT line) FROM src) AS lines, (SELECT count(*) FROM c) AS months, max(l_linestatus) AS high FROM src)
SELECT l_orderkey, l_linenumber, round((l_quantity - mean) / std, 6) AS quantity, l.slot AS line_slot, 1 + lines + c.slot AS month_slot,
       CASE WHEN l_linestatus = high THEN 1 + lines + months END AS status_slot
FROM src JOIN l USING (line) JOIN c USING (month), m, n""", ("I4", "I5", "I6", "I7", "I8"))
def features_sparse_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot slots of every order line: a column with a level for each line, months, a binary column and a scaled number."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_linestatus", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    pre = FT.fit_preprocessor(li, [], numeric=["l_quantity"], categorical=["line", "month"], binary=["l_linestatus"])
    rows = FT.sparse(pre, li, ["l_orderkey", "l_linenumber"])
    first = {c: pre.width[c][0] for c in ("line", "month", "l_linestatus")}
    of = lambda low, high: F.get(F.filter("slots", lambda s: (s >= low) & (s < high)), F.lit(0))
    value = F.when(F.get("slots", F.lit(0)) == 0, F.get("values", F.lit(0))).otherwise(0.0)
    return rows.select("l_orderkey", "l_linenumber", F.round(value, R6).alias("quantity"), of(first["line"], first["month"]).alias("line_slot"),
                       of(first["month"], first["l_linestatus"]).alias("month_slot"), of(first["l_linestatus"], pre.size).alias("status_slot"))


def _hash_sql(key: str, seed: int) -> str:
    return f"('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), '\\N') || '|{seed}'), 1, 15))::BIGINT"


@register("split_labels", f"""
WITH h AS (SELECT doc_id, quality, {_hash_sql('doc_id', 42)} AS h FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY h) AS rn, count(*) OVER (PARTITION BY quality) AS n FROM h)
SELECT doc_id, quality, rn <= round(n * 0.2) AS is_test FROM r""", ("I9",))
def split_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return FT.hash_rank_split(lb, ["doc_id"], "quality", 0.2, 42)


@register("folds_labels", f"""
WITH h AS (SELECT doc_id, toxic, {_hash_sql('doc_id', 7)} AS h FROM labels)
SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY h) - 1) % 5)::INTEGER AS fold FROM h""", ("M5",))
def folds_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return FT.fold_column(lb, ["doc_id"], "toxic", 5, 7)


@register("background_sample_documents", f"""
SELECT doc_id, n_chars FROM documents ORDER BY {_hash_sql('doc_id', 42)} LIMIT 500""", ("I14",))
def background_sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return FT.background_sample(d, ["doc_id"], 500, 42)


# ---------------------------------------------------------------- linear attribution on lineitem

LI_SLOTS = {"l_discount": 8.0, "l_quantity": 0.02, "l_tax": -10.0, "l_returnflag_A": 0.3, "l_returnflag_N": -0.2,
            "l_returnflag_R": 0.1, "l_linestatus_O": 0.5}
LI_B = -0.6
SLOT_FEATURE = {"l_discount": "l_discount", "l_quantity": "l_quantity", "l_tax": "l_tax", "l_returnflag_A": "l_returnflag",
                "l_returnflag_N": "l_returnflag", "l_returnflag_R": "l_returnflag", "l_linestatus_O": "l_linestatus"}


def li_design(spark, sf_dir) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax",
                     *[(F.col("l_returnflag") == f).cast("double").alias(f"l_returnflag_{f}") for f in "ANR"],
                     (F.col("l_linestatus") == "O").cast("double").alias("l_linestatus_O"))


def li_rows(spark, sf_dir):
    return X.linear_rows(li_design(spark, sf_dir), ["l_orderkey", "l_linenumber"], LI_SLOTS, LI_B)


def li_phi(spark, sf_dir):
    return X.linear_attribution(li_design(spark, sf_dir), ["l_orderkey", "l_linenumber"], LI_SLOTS, LI_B)


DESIGN_SQL = """SELECT row_number() OVER () AS rid, l_orderkey, l_linenumber, l_discount, l_quantity, l_tax, (l_returnflag = 'A')::DOUBLE AS l_returnflag_A,
  (l_returnflag = 'N')::DOUBLE AS l_returnflag_N, (l_returnflag = 'R')::DOUBLE AS l_returnflag_R, (l_linestatus = 'O')::DOUBLE AS l_linestatus_O FROM lineitem"""
W_SQL = "(VALUES " + ", ".join(f"('{k}', {v})" for k, v in LI_SLOTS.items()) + ") w(slot, weight)"
PHI_SQL = f"""
WITH d AS ({DESIGN_SQL}),
l AS (UNPIVOT d ON {', '.join(LI_SLOTS)} INTO NAME slot VALUE value),
mu AS (SELECT slot, avg(value) AS mean FROM l GROUP BY slot),
p AS (SELECT l.rid, l.l_orderkey, l.l_linenumber, l.slot, l.value, w.weight * (l.value - mu.mean) AS phi
      FROM l JOIN mu USING (slot) JOIN {W_SQL} USING (slot)),
b AS (SELECT sum(w.weight * mu.mean) + ({LI_B}) AS base_value FROM mu JOIN {W_SQL} USING (slot))"""


@register("attribution_global_lineitem", f"""{PHI_SQL}
SELECT slot AS feature, round(avg(abs(phi)), 6) AS mean_abs, round(stddev_pop(phi), 6) AS std, count(*) AS n,
       round(any_value(b.base_value), 6) AS base_value FROM p, b GROUP BY slot""", ("X1", "X3", "X8"))
def attribution_global_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi, base = li_phi(spark, sf_dir)
    return _r(X.global_attribution(phi, base), ["mean_abs", "std", "base_value"])


SLOT_MAP_SQL = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SLOT_FEATURE.items()) + ") sm(slot, feature)"


@register("attribution_folded_lineitem", f"""{PHI_SQL}
SELECT l_orderkey, l_linenumber, feature, phi FROM (
  SELECT rid, l_orderkey, l_linenumber, feature, round(sum(phi), 6) AS phi FROM p JOIN {SLOT_MAP_SQL} USING (slot) GROUP BY ALL)""", ("X5", "X9"))
def attribution_folded_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = li_rows(spark, sf_dir)
    return _r(X.exploded(X.fold_slots(rows, SLOT_FEATURE)), ["phi"])


@register("attribution_maps_lineitem", f"""{PHI_SQL},
f AS (SELECT rid, l_orderkey, l_linenumber, feature, sum(phi) AS phi FROM p JOIN {SLOT_MAP_SQL} USING (slot) GROUP BY ALL)
SELECT l_orderkey, l_linenumber, round(any_value(phi) FILTER (feature = 'l_discount'), 6) AS discount,
       round(any_value(phi) FILTER (feature = 'l_returnflag'), 6) AS returnflag, count(*) AS n_features
FROM f GROUP BY rid, l_orderkey, l_linenumber""", ("X9", "X4"))
def attribution_maps_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch of instance explanations as maps."""
    rows, _ = li_rows(spark, sf_dir)
    maps = X.as_maps(X.fold_slots(rows, SLOT_FEATURE))
    get = lambda name: F.round(F.element_at("attributions", F.lit(name)), R6)
    return maps.select("l_orderkey", "l_linenumber", get("l_discount").alias("discount"), get("l_returnflag").alias("returnflag"),
                       F.size("attributions").cast("long").alias("n_features"))


@register("attribution_instance_lineitem", f"""{PHI_SQL}
SELECT l_orderkey, l_linenumber, slot, value, round(phi, 6) AS phi FROM p WHERE l_orderkey = 7""", ("X4",))
def attribution_instance_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = li_rows(spark, sf_dir)
    return _r(X.exploded(X.instance_attribution(rows, {"l_orderkey": 7})), ["phi"])


@register("attribution_ranked_lineitem", f"""{PHI_SQL},
f AS (SELECT rid, feature, sum(phi) AS phi FROM p JOIN {SLOT_MAP_SQL} USING (slot) GROUP BY ALL),
g AS (SELECT feature, avg(abs(phi)) AS mean_abs FROM f GROUP BY feature)
SELECT feature, round(mean_abs, 6) AS mean_abs, row_number() OVER (ORDER BY mean_abs DESC, feature) AS rank FROM g
QUALIFY rank <= 20""", ("X6",))
def attribution_ranked_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = li_rows(spark, sf_dir)
    g = X.exploded(X.fold_slots(rows, SLOT_FEATURE)).groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs"))
    r = X.ranked_importance(g, 20)
    return r.select("feature", F.round("mean_abs", R6).alias("mean_abs"), F.col("rank").cast("long").alias("rank"))


@register("attribution_top_others_lineitem", f"""{PHI_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(phi) DESC, slot) AS rn FROM p)
SELECT l_orderkey, l_linenumber, name, phi FROM (
  SELECT rid, l_orderkey, l_linenumber, CASE WHEN rn <= 3 THEN slot ELSE 'others' END AS name, round(sum(phi), 6) AS phi
  FROM r GROUP BY ALL)""", ("X7",))
def attribution_top_others_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = li_rows(spark, sf_dir)
    return _r(X.exploded(X.top_n_with_others(rows, feature="slot", top_n=3)), ["phi"])


@register("attribution_dependence_lineitem", f"""{PHI_SQL}
SELECT slot AS feature, value, round(phi, 6) AS phi FROM p WHERE slot = 'l_discount'""", ("X11",))
def attribution_dependence_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    phi, _ = li_phi(spark, sf_dir)
    return _r(X.dependence(phi, which="l_discount"), ["phi"])
