"""Sinks and report tables.

Everything is written under a folder the caller passes (on a cluster: the
shared folder named by ``spark.checkpoint.dir`` or a table location), in
Parquet unless the format is the point (CSV / JSON at the edges).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.columns import col

# Fixed value: characters allowed in metric names; others become '_'.
METRIC_NAME_DISALLOWED = r"[^a-zA-Z0-9_\-./ :]"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] = ()) -> str:
    """Write a table (csv gets a header)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def report_json(df: DataFrame, ts: str | None = None) -> DataFrame:
    """One JSON text per row (to_json of the whole row), with a timestamp column."""
    stamp = F.lit(ts).cast("timestamp") if ts else F.current_timestamp()
    return df.select(stamp.alias("ts"), F.to_json(F.struct(*[col(c) for c in df.columns])).alias("report"))


def latest(reports: DataFrame, ts: str = "ts", value: str = "report") -> DataFrame:
    """The newest report (max_by over the timestamp: one aggregate, no sort)."""
    return reports.agg(F.max_by(col(value), col(ts)).alias(value), F.max(col(ts)).alias(ts))


def align_append(old: DataFrame, new: DataFrame) -> DataFrame:
    """Registry append: the old column order first, new columns after; columns
    missing on either side are null-filled (the reference fails when the old file
    has a column the new rows lack)."""
    merged = old.unionByName(new, allowMissingColumns=True)
    order = list(old.columns) + [c for c in new.columns if c not in old.columns]
    return merged.select(*[col(c) for c in order])


def read_appended(spark: SparkSession, path: str, first: Sequence[str] = ()) -> DataFrame:
    """All rows appended below a folder, with the columns of any of them; a row's missing columns are null.

    The columns of ``first`` lead, the others follow in the order of their names.
    """
    rows = spark.read.option("mergeSchema", True).parquet(path)
    return rows.select(*[col(c) for c in [*first, *sorted(set(rows.columns) - set(first))]])


def append_rows(df: DataFrame, path: str) -> str:
    """Append rows, whose columns may differ from the stored ones, as new files; stored files stay as they are.

    The cost is that of the new rows, however long the registry is. A column
    stored with another type is refused before anything is written.
    """
    try:
        stored = dict(read_appended(df.sparkSession, path).dtypes)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stored = {}
    other = {c: (stored[c], t) for c, t in df.dtypes if stored.get(c, t) != t}
    if other:
        raise ValueError(f"columns stored with other types: {other}")
    df.write.mode("append").parquet(path)
    return path


def sanitize_metric(name) -> F.Column:
    return F.regexp_replace(name, METRIC_NAME_DISALLOWED, "_")


def metrics_table(tests: DataFrame, run: str, step_col: str | None = None) -> DataFrame:
    """Drift test rows flattened to (run, metric, step, value) with sanitised names:
    <feature>/<test>/statistic, <feature>/<test>/p_value and <feature>/<test>/drifted."""
    step = col(step_col) if step_col else F.lit(0)
    base = tests.select(step.alias("step"), "feature", "test", "statistic", "p_value",
                        F.col("drift_detected").cast("double").alias("drifted"))
    long = base.unpivot(["step", "feature", "test"], ["statistic", "p_value", "drifted"], "measure", "value")
    return long.where(F.col("value").isNotNull()).select(
        F.lit(run).alias("run"), sanitize_metric(F.concat_ws("/", "feature", "test", "measure")).alias("metric"),
        F.col("step").cast("long").alias("step"), F.col("value").cast("double").alias("value"))
