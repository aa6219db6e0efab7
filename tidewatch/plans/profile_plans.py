"""Profiling, fingerprint and imputation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import clean as K
from tidewatch.operators import impute as I
from tidewatch.operators import profile as A
from tidewatch.operators import sketches as Z
from tidewatch.operators.columns import attach_row
from tidewatch.plans.catalog import register
from tidewatch.plans.clean_plans import CONTACT_ORACLE, _q, contacts_view
from tidewatch.plans.sink_plans import scratch
from tidewatch.sources import sinks as SK
from tidewatch.sources.tables import read_table

R6 = 6


def _r(df: DataFrame, cols) -> DataFrame:
    return df.select(*[F.round(c, R6).alias(c) if c in cols else F.col(c) for c in df.columns])


LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUARTILES = (0.25, 0.5, 0.75)


@register("profile_numeric_lineitem", "\nUNION ALL\n".join(f"""
SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem""" for c in LI_NUM),
          ("A1",))
def profile_numeric_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = A.numeric_profile(read_table(spark, sf_dir, "lineitem"), LI_NUM)
    return _r(p, ["mean", "std", "min", "max", "q25", "q50", "q75"])


@register("profile_categorical_part", """
WITH l AS (SELECT 'p_brand' AS feature, p_brand AS category FROM part UNION ALL
           SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part),
c AS (SELECT feature, category, count(*) AS n FROM l WHERE category IS NOT NULL GROUP BY ALL)
SELECT feature, category, n, round(n / sum(n) OVER (PARTITION BY feature), 6) AS share FROM c""", ("A2", "A3"))
def profile_categorical_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    return _r(A.categorical_profile(p, ["p_brand", "p_type", "p_size"]), ["share"])


DOC_LABELS = ("SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, "
              "CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.toxic = 0 THEN 'clean' END AS toxic_text "
              "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")


def _doc_labels(spark, sf_dir) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    lb = read_table(spark, sf_dir, "labels")
    j = d.join(lb, "doc_id", "left")
    return j.withColumn("toxic_text", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean"))


@register("profile_overview_documents", f"""
WITH j AS ({DOC_LABELS})
SELECT count(*) AS rows, 7::BIGINT AS columns,
  round((count(*) FILTER (WHERE doc_id IS NULL) + count(*) FILTER (WHERE lang IS NULL) + count(*) FILTER (WHERE source IS NULL)
   + count(*) FILTER (WHERE n_chars IS NULL) + count(*) FILTER (WHERE quality IS NULL) + count(*) FILTER (WHERE toxic IS NULL)
   + count(*) FILTER (WHERE toxic_text IS NULL)) * 100.0 / (count(*) * 7), 1) AS missing_pct FROM j""", ("A4",))
def profile_overview_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.overview(_doc_labels(spark, sf_dir))


@register("profile_missing_documents", f"""
WITH j AS ({DOC_LABELS}),
s AS (UNPIVOT (SELECT avg((doc_id IS NULL)::DOUBLE) AS doc_id, avg((lang IS NULL)::DOUBLE) AS lang,
        avg((source IS NULL)::DOUBLE) AS source, avg((n_chars IS NULL)::DOUBLE) AS n_chars,
        avg((quality IS NULL)::DOUBLE) AS quality, avg((toxic IS NULL)::DOUBLE) AS toxic,
        avg((toxic_text IS NULL)::DOUBLE) AS toxic_text FROM j) ON COLUMNS(*) INTO NAME "column" VALUE missing_share)
SELECT "column", round(missing_share, 6) AS missing_share FROM
  (SELECT * FROM s ORDER BY missing_share DESC, "column" LIMIT 20) WHERE missing_share > 0""", ("A5",))
def profile_missing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(A.missing_share(_doc_labels(spark, sf_dir), 20), ["missing_share"])


def _hist_sql(table: str, v: str, bins: int, by: str | None) -> str:
    g = f"{by}, " if by else ""
    gsel = f"{by} AS grp, " if by else ""
    join = f"USING ({by})" if by else "ON TRUE"
    return f"""
WITH b AS (SELECT {g}{v}::DOUBLE AS v FROM {table} WHERE {v} IS NOT NULL {f'AND {by} IS NOT NULL' if by else ''}),
r0 AS (SELECT {g}min(v) AS lo, max(v) AS hi FROM b GROUP BY ALL),
r AS (SELECT {g}CASE WHEN lo = hi THEN lo - 0.5 ELSE lo END AS first, CASE WHEN lo = hi THEN hi + 0.5 ELSE hi END AS last,
             {bins}::BIGINT AS nb FROM r0),
x0 AS (SELECT b.*, r.first, r.last, r.nb, trunc((b.v - r.first) / (r.last - r.first) * r.nb)::BIGINT AS i0 FROM b JOIN r {join}),
x1 AS (SELECT *, CASE WHEN i0 >= nb THEN nb - 1 ELSE i0 END AS i1 FROM x0),
x2 AS (SELECT *, CASE WHEN v < (CASE WHEN i1 >= nb THEN last ELSE i1::DOUBLE * ((last - first) / nb) + first END) THEN i1 - 1 ELSE i1 END AS i2 FROM x1),
x3 AS (SELECT *, CASE WHEN v >= (CASE WHEN i2 + 1 >= nb THEN last ELSE (i2 + 1)::DOUBLE * ((last - first) / nb) + first END)
                       AND i2 <> nb - 1 THEN i2 + 1 ELSE i2 END AS bin FROM x2),
c AS (SELECT {g}bin, count(*) AS cnt FROM x3 GROUP BY ALL),
grid AS (SELECT r.*, g.bin FROM r, LATERAL (SELECT unnest(range(0, r.nb)) AS bin) g)
SELECT {('grid.' + by + ' AS ' + by + ', ') if by else ''}grid.bin, round(grid.bin * ((grid.last - grid.first) / grid.nb) + grid.first, 6) AS lo,
  round(CASE WHEN grid.bin = grid.nb - 1 THEN grid.last ELSE (grid.bin + 1) * ((grid.last - grid.first) / grid.nb) + grid.first END, 6) AS hi,
  coalesce(c.cnt, 0)::BIGINT AS count
FROM grid LEFT JOIN c ON grid.bin = c.bin {('AND grid.' + by + ' = c.' + by) if by else ''}"""


@register("profile_histogram_orders", _hist_sql("orders", "o_totalprice", 20, None), ("A6",))
def profile_histogram_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(A.histogram(read_table(spark, sf_dir, "orders"), "o_totalprice", 20), ["lo", "hi"])


@register("profile_histogram_by_status", _hist_sql("orders", "o_totalprice", 15, "o_orderstatus"), ("A6",))
def profile_histogram_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(A.histogram(read_table(spark, sf_dir, "orders"), "o_totalprice", 15, by="o_orderstatus"), ["lo", "hi"])


def _contacts(spark, sf_dir) -> DataFrame:
    return K.contact_dataset(contacts_view(spark, sf_dir))


SYMS = K.FOLLOWUP_SYMPTOMS


def _unpivot_sql(cols) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {_q(c)} AS value FROM k" for c in cols)


@register("profile_prevalence_contacts", f"""
WITH k AS ({CONTACT_ORACLE}), l AS ({_unpivot_sql(SYMS)})
SELECT feature, round(coalesce(count(*) FILTER (WHERE value = 'YES') * 100.0 / nullif(count(value), 0), 0.0), 6) AS pct,
  count(*) FILTER (WHERE value = 'YES') AS count,
  round(count(*) FILTER (WHERE value = 'YES') * 100.0 / count(*), 6) AS pct_all_rows FROM l GROUP BY feature""",
          ("A7", "A8", "A9"))
def profile_prevalence_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _contacts(spark, sf_dir)
    a7 = A.prevalence(k, SYMS)
    a8 = A.prevalence(k, SYMS, over_all_rows=True).select("feature", F.col("pct").alias("pct_all_rows"))
    return _r(a7.join(a8, "feature"), ["pct", "pct_all_rows"])


@register("profile_stacked_contacts", f"""
WITH k AS ({CONTACT_ORACLE}), l AS ({_unpivot_sql(SYMS)})
SELECT feature, count(*) FILTER (WHERE value = 'YES') AS YES, count(*) FILTER (WHERE value = 'NO') AS NO FROM l GROUP BY feature""",
          ("A10",))
def profile_stacked_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.stacked_counts(_contacts(spark, sf_dir), SYMS)


@register("profile_multi_symptom", f"""
WITH k AS ({CONTACT_ORACLE})
SELECT count(*) FILTER (WHERE {' + '.join(_q(s + '_BINARY') for s in SYMS)} >= 2) AS rows FROM k""", ("A12",))
def profile_multi_symptom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.multi_flag_count(_contacts(spark, sf_dir), [s + "_BINARY" for s in SYMS])


@register("profile_crosstab_lineitem", """
WITH c AS (SELECT l_returnflag AS row_value, l_linestatus AS column_value, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT row_value, column_value, round(n * 100.0 / sum(n) OVER (PARTITION BY row_value), 6) AS pct FROM c""", ("A11",))
def profile_crosstab_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(A.crosstab_pct(read_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus"), ["pct"])


@register("profile_describe_part", """
SELECT 'p_size' AS feature, count(p_size) AS count, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS std,
  round(min(p_size), 6) AS min, round(quantile_cont(p_size::DOUBLE, 0.25), 6) AS q25, round(quantile_cont(p_size::DOUBLE, 0.5), 6) AS q50,
  round(quantile_cont(p_size::DOUBLE, 0.75), 6) AS q75, round(max(p_size), 6) AS max, NULL::BIGINT AS unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq FROM part
UNION ALL
SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 6), round(stddev_samp(p_retailprice), 6), round(min(p_retailprice), 6),
  round(quantile_cont(p_retailprice, 0.25), 6), round(quantile_cont(p_retailprice, 0.5), 6), round(quantile_cont(p_retailprice, 0.75), 6),
  round(max(p_retailprice), 6), NULL, NULL, NULL FROM part
UNION ALL
SELECT feature, sum(n), NULL, NULL, NULL, NULL, NULL, NULL, NULL, count(*), arg_min(category, (-n, category)), max(n)
FROM (SELECT 'p_type' AS feature, p_type AS category, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part WHERE p_brand IS NOT NULL GROUP BY ALL) GROUP BY feature""", ("A14",))
def profile_describe_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.describe(read_table(spark, sf_dir, "part"), ["p_size", "p_retailprice", "p_type", "p_brand"])
    return _r(d, ["mean", "std", "min", "q25", "q50", "q75", "max"])


@register("profile_distinct_lineitem", """
UNPIVOT (SELECT count(DISTINCT l_partkey) AS l_partkey, count(DISTINCT l_suppkey) AS l_suppkey, count(DISTINCT l_quantity) AS l_quantity,
  count(DISTINCT l_returnflag) AS l_returnflag, count(DISTINCT l_shipdate) AS l_shipdate FROM lineitem)
ON COLUMNS(*) INTO NAME feature VALUE n_distinct""", ("A15",))
def profile_distinct_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.distinct_counts(read_table(spark, sf_dir, "lineitem"),
                             ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"])


@register("profile_sketch_lineitem", "\nUNION ALL\n".join(f"""
SELECT year(l_shipdate)::INTEGER AS year, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(max({c}), 6) AS max, true AS quantiles_in_bound, true AS distinct_in_bound
FROM lineitem GROUP BY ALL HAVING count({c}) > 0""" for c in LI_NUM), ("A1", "A14", "A15"))
def profile_sketch_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly sketch rows are stored, then merged to years; estimates are held against the exact ranks and counts."""
    li = read_table(spark, sf_dir, "lineitem").withColumn("year", F.year("l_shipdate"))
    path = scratch(spark, "profile-sketches")
    Z.sketch_profile(li.withColumn("month", F.month("l_shipdate")), LI_NUM, by=["year", "month"]).write.parquet(path)
    years = Z.read_profile(Z.merge_profiles(spark.read.parquet(path), ["year"]), QUARTILES)
    counts = (li.select("year", *LI_NUM).unpivot(["year"], LI_NUM, "feature", "value").where("value is not null")
              .groupBy("year", "feature", "value").agg(F.count(F.lit(1)).alias("c")))
    at = F.col("e.year").eqNullSafe(F.col("l.year")) & (F.col("e.feature") == F.col("l.feature"))
    share = lambda test: F.sum(F.when(test, F.col("c")).otherwise(0)) / F.sum("c")
    inside = [(share(F.col("value") < F.col("q")[i]) - Z.rank_bound() <= p) & (share(F.col("value") <= F.col("q")[i]) + Z.rank_bound() >= p)
              for i, p in enumerate(QUARTILES)]
    return _r(years.alias("e").join(counts.alias("l"), at).groupBy("e.year", "e.feature").agg(
        F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("mean", "std", "min", "max")],
        (inside[0] & inside[1] & inside[2]).alias("quantiles_in_bound"),
        (F.abs(F.first("n_distinct") - F.count(F.lit(1))) <= Z.distinct_bound() * F.count(F.lit(1))).alias("distinct_in_bound")),
        ["mean", "std", "min", "max"])


@register("class_balance_labels", """
SELECT count(*) FILTER (WHERE quality = 0) AS n_neg, count(*) FILTER (WHERE quality = 1) AS n_pos,
  round(count(*) FILTER (WHERE quality = 0)::DOUBLE / count(*) FILTER (WHERE quality = 1), 6) AS scale_pos_weight,
  least(count(*) FILTER (WHERE quality = 0), count(*) FILTER (WHERE quality = 1)) AS min_class_size FROM labels""", ("A16",))
def class_balance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _r(A.class_balance(read_table(spark, sf_dir, "labels"), "quality"), ["scale_pos_weight"])


@register("class_weights_labels", """
WITH c AS (SELECT toxic, count(*) AS nc FROM labels GROUP BY toxic)
SELECT l.doc_id, l.toxic, round((SELECT sum(nc) FROM c) / ((SELECT count(*) FROM c) * c.nc), 6) AS weight
FROM labels l JOIN c ON l.toxic IS NOT DISTINCT FROM c.toxic""", ("A17",))
def class_weights_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = A.balanced_weights(read_table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic")
    return _r(w, ["weight"])


FP_SQL = """SELECT count(*) AS n_rows, CAST(coalesce(sum(h::HUGEINT), 0) AS VARCHAR) || '-' || lower(lpad(hex(coalesce(bit_xor(h), 0)), 15, '0')) AS fingerprint
FROM (SELECT ('0x' || substr(md5(
  coalesce(CAST(o_orderkey AS VARCHAR), '\\N') || '|' || coalesce(CAST(o_custkey AS VARCHAR), '\\N') || '|' ||
  coalesce(o_orderstatus, '\\N') || '|' || coalesce(CAST(round(o_totalprice, 6)::DECIMAL(38, 6) AS VARCHAR), '\\N') || '|' ||
  coalesce(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '\\N') || '|' || coalesce(o_orderpriority, '\\N')), 1, 15))::BIGINT AS h FROM orders)"""

FP_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@register("fingerprint_orders", FP_SQL, ("A18",))
def fingerprint_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.fingerprint(read_table(spark, sf_dir, "orders"), FP_COLS)


@register("fingerprint_incremental_orders", f"SELECT f.*, 0::BIGINT AS n_hashed_again, true AS state_changed FROM ({FP_SQL}) f", ("A18", "A21", "M13"))
def fingerprint_incremental_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders arrive in two parts; the second check hashes the files of the second part alone and
    has the fingerprint of the whole table."""
    o = read_table(spark, sf_dir, "orders")
    path, first, second = scratch(spark, "fp-orders"), scratch(spark, "fp-state"), scratch(spark, "fp-state")
    early = F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")
    SK.write_table(o.where(F.coalesce(early, F.lit(False))), path)
    SK.write_table(A.file_fingerprints(spark, path, None, FP_COLS), first)
    known = spark.read.parquet(first)
    SK.write_table(o.where(~F.coalesce(early, F.lit(False))), path, mode="append")
    SK.write_table(A.file_fingerprints(spark, path, known, FP_COLS), second)
    now = spark.read.parquet(second)
    before, after = A.files_fingerprint(known), A.files_fingerprint(now)
    again = A.file_fingerprints(spark, path, now, FP_COLS).join(now, A.FILE_KEY, "left_anti").agg(F.count("*").alias("n_hashed_again"))
    return attach_row(attach_row(after, again), A.changed_since(after, before).select(F.col("changed").alias("state_changed")))


@register("change_gate_orders", f"""
WITH cur AS ({FP_SQL}), old AS ({FP_SQL.replace('FROM orders', "FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01'")})
SELECT cur.n_rows AS current_rows, cur.fingerprint AS current_fingerprint, old.n_rows AS stored_rows,
       old.fingerprint AS stored_fingerprint, coalesce(cur.fingerprint <> old.fingerprint, true) AS changed FROM cur, old""",
          ("A21",))
def change_gate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored state is the fingerprint of the table as it stood before 2001."""
    o = read_table(spark, sf_dir, "orders")
    state = A.fingerprint(o.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")), FP_COLS)
    return A.changed_since(A.fingerprint(o, FP_COLS), state)


@register("impute_documents", f"""
WITH j AS ({DOC_LABELS}),
f AS (SELECT coalesce(quantile_cont(n_chars::DOUBLE, 0.5), 0.0) AS n_chars, coalesce(quantile_cont(quality::DOUBLE, 0.5), 0.0) AS quality,
             coalesce(quantile_cont(toxic::DOUBLE, 0.5), 0.0) AS toxic,
             (SELECT coalesce(arg_min(toxic_text, (-n, toxic_text)), 'NO') FROM (SELECT toxic_text, count(*) AS n FROM j WHERE toxic_text IS NOT NULL GROUP BY ALL)) AS toxic_text
      FROM j)
SELECT j.doc_id, j.lang, j.source, round(coalesce(j.n_chars::DOUBLE, f.n_chars), 6) AS n_chars, round(coalesce(j.quality::DOUBLE, f.quality), 6) AS quality,
       round(coalesce(j.toxic::DOUBLE, f.toxic), 6) AS toxic, coalesce(j.toxic_text, f.toxic_text) AS toxic_text FROM j, f""", ("I1", "I2"))
def impute_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = I.impute(_doc_labels(spark, sf_dir), skip=("doc_id",) + I.TARGET_COLUMNS + I.DATE_COLUMNS)
    return _r(out, ["n_chars", "quality", "toxic"])


@register("feature_roles_documents", f"""
WITH j AS ({DOC_LABELS})
SELECT * FROM (VALUES ('n_chars', 'numeric', 0), ('quality', 'numeric', 1)) t(feature, role, position)
UNION ALL SELECT 'lang', CASE WHEN (SELECT count(DISTINCT lang) FROM j) <= 2 THEN 'binary' ELSE 'categorical' END, 2
UNION ALL SELECT 'toxic_text', CASE WHEN (SELECT count(DISTINCT toxic_text) FROM j) <= 2 THEN 'binary' ELSE 'categorical' END, 3""",
          ("I3",))
def feature_roles_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.feature_roles(_doc_labels(spark, sf_dir), ["n_chars", "quality", "lang", "toxic_text"])
