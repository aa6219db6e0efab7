"""Source and sink round trips (S1-S15, P1, P7) over files written by Spark from
the given tables into the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.normalize import safe_double
from tidewatch.operators.columns import col
from tidewatch.plans.catalog import register
from tidewatch.session import checkpoint_dir, ensure_local_checkpoint_dir
from tidewatch.sources import sinks as SK
from tidewatch.sources import tables as SRC
from tidewatch.sources.tables import read_table

R6 = 6


def scratch(spark: SparkSession, name: str) -> str:
    base = checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


SHEET_RENAME = {"Unnamed: 1": "NAME", "DURATION": "BALANCE", "DURATION.1": "NATION"}


@register("sheet_roundtrip_customer", """
SELECT 'S' || CAST(c_custkey AS VARCHAR) AS "Sample ID", c_name AS NAME, c_acctbal AS BALANCE,
       c_nationkey::BIGINT AS NATION, 'customers' AS SOURCE FROM customer""",
          ("S1", "S2", "S3", "S4", "S5", "S6", "S8", "P1", "P7"))
def sheet_roundtrip_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write customer as a sheet with a trailing-space key header, positional and
    duplicated headers and a sub-header row; read it back with header cleanup."""
    c = read_table(spark, sf_dir, "customer")
    body = c.select(F.concat(F.lit("S"), F.col("c_custkey").cast("string")).alias("Sample ID "),
                    F.col("c_name").alias("Unnamed: 1"), F.col("c_acctbal").cast("string").alias("DURATION"),
                    F.col("c_nationkey").cast("string").alias("DURATION.1"))
    sub = spark.createDataFrame([("(id)", "(name)", "(kes)", "(code)")], body.schema)
    path = scratch(spark, "sheet")
    SK.write_table(sub.unionByName(body), path, fmt="csv")
    schema = "`Sample ID ` string, `Unnamed: 1` string, DURATION string, `DURATION.1` string"
    df = SRC.read_sheet(spark, path, schema=schema, rename=SHEET_RENAME, source="customers",
                        subheader_col="Sample ID", subheader_value="(id)")
    return df.select("Sample ID", "NAME", safe_double(col("BALANCE")).alias("BALANCE"),
                     safe_double(col("NATION")).cast("long").alias("NATION"), "SOURCE")


def _reg_sql():
    from tidewatch.plans.registry_plans import REGISTRY_SQL
    return REGISTRY_SQL


@register("json_metadata_scan", f"""
SELECT aim, model, version, cv_auc_mean, train_auc, model_path FROM ({_reg_sql()})""", ("S9",))
def json_metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model metadata JSON files from the registry view, one corrupt file among them;
    scanned with a name pattern and PERMISSIVE mode (the corrupt row is dropped)."""
    from tidewatch.plans.registry_plans import registry_view
    reg = registry_view(spark, sf_dir).drop("features")
    path = scratch(spark, "metadata")
    reg.write.mode("overwrite").json(path)
    spark.createDataFrame([("{not json",)], "value string").coalesce(1).write.mode("append").text(path + "/corrupt")
    schema = "aim string, model string, version string, cv_auc_mean double, train_auc double, model_path string, _bad string"
    got = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
           .option("pathGlobFilter", "part-*").option("recursiveFileLookup", True).json(path))
    return got.where(F.col("_bad").isNull()).drop("_bad")


REGISTRY_SPLIT = "regexp_extract(version, '\\\\d+', 0)::INTEGER % 100 <= 15"


REGISTRY_APPEND_SQL = f"""
WITH r AS (SELECT aim, model, version, cv_auc_mean, train_auc, model_path,
                  regexp_extract(version, '\\d+', 0)::INTEGER % 100 AS d FROM ({_reg_sql()}))
SELECT aim, model, version, cv_auc_mean, model_path, 'run ' || version AS notes, NULL::DOUBLE AS train_auc FROM r WHERE d <= 15
UNION ALL SELECT aim, model, version, cv_auc_mean, model_path, NULL, train_auc FROM r WHERE d > 15"""


def _registry_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from tidewatch.plans.registry_plans import registry_view
    reg = registry_view(spark, sf_dir).drop("features")
    day = F.regexp_extract("version", r"\d+", 0).cast("int") % 100
    old = reg.where(day <= 15).drop("train_auc").withColumn("notes", F.concat(F.lit("run "), F.col("version")))
    return old, reg.where(day > 15)


@register("registry_append", REGISTRY_APPEND_SQL, ("S13",))
def registry_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old registry rows carry a ``notes`` column and no ``train_auc``; new rows the
    opposite; the append aligns both ways."""
    old, new = _registry_parts(spark, sf_dir)
    path = scratch(spark, "registry")
    SK.write_table(old, path)
    merged = SK.align_append(spark.read.parquet(path), new)
    SK.write_table(merged, path + "_v2")
    return spark.read.parquet(path + "_v2")


@register("registry_append_files", REGISTRY_APPEND_SQL, ("S13",))
def registry_append_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same append as new files, stored ones left alone; the columns meet when they are read."""
    old, new = _registry_parts(spark, sf_dir)
    path = scratch(spark, "registry-files")
    SK.append_rows(old, path)
    SK.append_rows(new, path)
    return SK.read_appended(spark, path, old.columns)


def _metrics_sql():
    from tidewatch.plans.drift_plans import drift_events as _q  # noqa: F401
    from tidewatch.plans.catalog import ORACLES
    return f"""
WITH t AS ({ORACLES['drift_events']}),
l AS (SELECT feature, test, 'statistic' AS measure, statistic AS value FROM t
      UNION ALL SELECT feature, test, 'p_value', p_value FROM t
      UNION ALL SELECT feature, test, 'drifted', drift_detected::DOUBLE FROM t)
SELECT 'events_drift' AS run, regexp_replace(feature || '/' || test || '/' || measure, '[^a-zA-Z0-9_\\-./ :]', '_', 'g') AS metric,
       0::BIGINT AS step, round(value, 6) AS value FROM l WHERE value IS NOT NULL"""


@register("metrics_events", _metrics_sql(), ("S15",))
def metrics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidewatch.plans.drift_plans import events_report
    return SK.metrics_table(events_report(spark, sf_dir).tests, "events_drift").withColumn("value", F.round("value", R6))


def _latest_sql():
    from tidewatch.plans.window_plans import WINDOWS_SQL
    return f"""SELECT window_start, n_records, drift_ratio, drift_detected FROM ({WINDOWS_SQL})
ORDER BY window_start DESC LIMIT 1"""


@register("report_latest_events", _latest_sql(), ("S10", "S11", "S12"))
def report_latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-window verdicts written as JSON report rows (one per window, stamped with
    the window start); the newest report is read back and unpacked."""
    from tidewatch.plans.window_plans import _windows
    from tidewatch.operators.monitor import WKEY
    w = _windows(spark, sf_dir)
    reports = w.select(F.col(WKEY).alias("ts"), F.to_json(F.struct(*w.columns)).alias("report"))
    path = scratch(spark, "reports")
    SK.write_table(reports, path, fmt="json")
    back = spark.read.schema("ts timestamp, report string").json(path)
    last = SK.latest(back)
    return last.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                       F.get_json_object("report", "$.n_records").cast("long").alias("n_records"),
                       F.get_json_object("report", "$.drift_ratio").cast("double").alias("drift_ratio"),
                       F.get_json_object("report", "$.drift_detected").cast("boolean").alias("drift_detected"))


@register("rows_from_json_events", """
SELECT event_id, 0 AS row_pos, event_type AS name, CAST(value AS VARCHAR) AS amount FROM events
UNION ALL SELECT event_id, 1, 'k', json_extract_string(props, '$.k') FROM events""", ("S14",))
def rows_from_json_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-rows payload per event (two objects) parsed back into typed rows."""
    ev = read_table(spark, sf_dir, "events")
    payload = F.format_string('[{"name": "%s", "amount": "%s"}, {"name": "k", "amount": "%s"}]',
                              F.col("event_type"), F.col("value").cast("string"), F.get_json_object("props", "$.k"))
    rows = SRC.rows_from_json(ev.select("event_id", payload.alias("payload")), "payload")
    return rows.select("event_id", F.col("row_pos"), F.col("record")["name"].alias("name"),
                       F.col("record")["amount"].alias("amount"))


@register("csv_inferred_orders", """
SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 6) AS o_totalprice FROM orders""", ("S6",))
def csv_inferred_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders written as CSV and read back with an inferred schema."""
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    path = scratch(spark, "csv-inferred")
    SK.write_table(read_table(spark, sf_dir, "orders").select(*cols), path, fmt="csv")
    df = SRC.read_sheet(spark, path)
    return df.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderstatus",
                     F.round("o_totalprice", R6).alias("o_totalprice"))


@register("csv_malformed_lines", """
SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey % 10 <> 0""", ("S7",))
def csv_malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as CSV lines, every tenth with a key that is no number; such lines are skipped."""
    c = read_table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 10 == 0, F.lit("oops")).otherwise(F.col("c_custkey").cast("string"))
    path = scratch(spark, "csv-malformed")
    SK.write_table(c.select(key.alias("c_custkey"), "c_name", F.col("c_nationkey").cast("string").alias("c_nationkey")), path, fmt="csv")
    # a projection of fewer columns would let the parser skip the bad field unseen
    return SRC.read_sheet(spark, path, schema="c_custkey long, c_name string, c_nationkey int", drop_malformed=True)
