"""Helpers shared by the corpus operators: words, shared folder, row numbers."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that one task numbers at a time in ``numbered``.
ROWS_PER_BUCKET = 2048


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Where a local session has none (tests, single-machine runs), a folder below the
    warehouse is used and set, so that later calls agree. A cluster has to name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write a table to the shared folder and read it back.

    Compressed and columnar, so smaller than ``checkpoint()``; a lost executor
    costs a read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def identified(docs: DataFrame, label: str) -> DataFrame:
    """(row, own): an identity of each row that scans agree on, and its columns as one struct.

    Rows of files are known by their file (64 bits of a hash of its path) and their place in it, however a
    scan splits the files; the rows of other plans are written once with a number. No
    column of ``own`` can clash with one beside it.
    """
    own = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own")
    if one_row_each(docs):
        try:
            file = docs.metadataColumn("_metadata")
            return docs.select(F.struct(F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("at")).alias("row"), own)
        except AnalysisException:  # a relation that is no files, or files without places
            pass
    at = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return written(docs.select(at.alias("row"), own), label)


def one_row_each(docs: DataFrame) -> bool:
    """Whether every row is a row of one relation: nothing but columns and filters lies above it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty()


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def uniform(*cols: Column) -> Column:
    """A hash of the columns as a double strictly between 0 and 1."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(2 ** 53))


def numbered(df: DataFrame, groups: list[str], order: list[str], spread: str, rows: int, name: str,
             n_groups: int = 1) -> DataFrame:
    """Gapless numbers from 0 within each group, without a task for a whole group.

    ``spread`` names a column that is uniform in (0, 1) within the group; it cuts
    each group into buckets of about ROWS_PER_BUCKET rows in the order of that
    column. Rows are numbered inside buckets, and buckets get offsets from their
    counts. ``order`` settles the order inside a bucket.
    """
    buckets = max(1, math.ceil(rows / (max(1, n_groups) * ROWS_PER_BUCKET)))
    with_bucket = df.withColumn("_bucket", F.floor(F.col(spread) * buckets))
    counts = with_bucket.groupBy(*groups, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*groups, "_bucket").orderBy(spread, *order)
    return (with_bucket.withColumn("_in", F.row_number().over(inside) - 1)
            .join(offsets, [*groups, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_in"))
            .drop("_bucket", "_in", "_before"))
