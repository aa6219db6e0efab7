"""Scans: parquet tables, CSV sheets with messy headers, JSON metadata files,
and rows carried as JSON text (S1-S7, S9, S14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.columns import col

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; column pruning and filters reach the reader through Catalyst."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_sheet(spark: SparkSession, path: str, schema: str | None = None, rename: Mapping[str, str] | None = None,
               source: str | None = None, subheader_col: str | None = None, subheader_value: str | None = None,
               drop_malformed: bool = False, corrupt_col: str | None = None) -> DataFrame:
    """CSV sheet with header cleanup.

    Headers are trimmed (S3); positional or duplicated headers are renamed by
    map (S1, S2, S4); a sub-header row is removed by a predicate on its
    content, not by position (P7); ``SOURCE`` is tagged when given. Malformed
    lines are dropped (S7) or kept in ``corrupt_col`` for quarantine.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    if schema:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    if drop_malformed:
        reader = reader.option("mode", "DROPMALFORMED")
    elif corrupt_col:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_col)
    df = reader.csv(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if rename:
        df = df.withColumnsRenamed({k: v for k, v in rename.items() if k in df.columns})
    if subheader_col and subheader_col in df.columns:
        df = df.where(col(subheader_col).isNull() | (col(subheader_col) != F.lit(subheader_value)))
    if source is not None:
        df = df.withColumn("SOURCE", F.lit(source))
    return df


def read_json_records(spark: SparkSession, path: str, schema: str, glob: str | None = None,
                      multiline: bool = True) -> DataFrame:
    """Multi-file JSON scan by name pattern; corrupt files become nulls (PERMISSIVE)."""
    reader = spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(path)


def rows_from_json(df: DataFrame, json_col: str, value_type: str = "string") -> DataFrame:
    """A column holding a JSON array of objects -> one row per object as a map."""
    parsed = F.from_json(col(json_col), f"array<map<string,{value_type}>>")
    return df.select("*", F.posexplode(parsed).alias("row_pos", "record"))


def rows_to_columns(df: DataFrame, map_col: str, fields: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    """S14 follow-up: map entries -> typed columns (missing keys become null)."""
    types = types or {}
    return df.select(*[F.try_element_at(col(map_col), F.lit(f)).cast(types.get(f, "string")).alias(f) for f in fields])
