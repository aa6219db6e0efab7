"""Windowed drift monitoring on a Structured Streaming source (T1-T5 on streams).

The stream keeps only aggregated state: counts per (event-time window,
feature, value). With a watermark and append mode, each window's counts are
emitted once, after the watermark passes its end; ``foreachBatch`` then runs
the same window tests as the batch path against the static, pre-aggregated
reference and writes the results. Each batch writes to its own
``batch_id=<n>`` folder with overwrite, so a batch replayed after a failure
replaces its own output (idempotent sink). Output and checkpoints live under
the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators import drift as D
from tidewatch.operators import monitor as T
from tidewatch.operators.columns import col
from tidewatch.operators.reference import Reference, prepare
from tidewatch.session import checkpoint_dir, ensure_local_checkpoint_dir

ROWS_FEATURE = "__rows__"
FINAL = -1  # batch id of the final flush


def stream_counts(stream: DataFrame, time_col: str, num: Sequence[str], cat: Sequence[str], duration: str,
                  watermark: str) -> DataFrame:
    """Streaming aggregate: (window, feature, value, category, n) with a watermark."""
    ts = col(time_col).cast("timestamp").alias("_ts")
    base = stream.select(ts, *[col(c).alias(c) for c in list(num) + list(cat)]).withWatermark("_ts", watermark)
    parts = []
    if num:
        parts.append(base.select("_ts", *[col(c).cast("double").alias(c) for c in num])
                     .unpivot(["_ts"], list(num), "feature", "value")
                     .where(F.col("value").isNotNull() & ~F.isnan("value"))
                     .withColumn("category", F.lit(None).cast("string")))
    cat_cols = list(cat)
    cat_base = base.select("_ts", *[col(c).cast("string").alias(c) for c in cat_cols],
                           F.lit("all").alias(ROWS_FEATURE))
    parts.append(cat_base.unpivot(["_ts"], cat_cols + [ROWS_FEATURE], "feature", "category")
                 .where(F.col("category").isNotNull())
                 .withColumn("value", F.lit(None).cast("double")))
    long = parts[0]
    for p in parts[1:]:
        long = long.unionByName(p)
    return long.groupBy(F.window("_ts", duration).alias("window"), "feature", "value", "category").agg(
        F.count(F.lit(1)).alias("n"))


def prepared_reference(reference: DataFrame, feature_cols: Sequence[str]) -> tuple[Reference, list[str], list[str], int]:
    """The reference's tables, written once for all batches, its numeric and other columns, and their number."""
    feature_cols = [c for c in feature_cols if c in reference.columns]
    rnum, rcat, num, cat = T.reference_counts(reference, feature_cols)
    return prepare(rnum, rcat, D.PSI_DEFAULT_BINS, D.PSI_SHARE_FLOOR), num, cat, len(feature_cols)


def write_windows(counts: DataFrame, prepared: Reference, n_features: int, out_dir: str, tag: str) -> None:
    """Test the windows in ``counts`` and write them to their own ``batch_id=<tag>`` folder."""
    b = counts.select(F.col("window.start").alias(T.WKEY), "feature", "value", "category", "n").persist()
    if b.isEmpty():  # e.g. the batch before the watermark first passes a window end
        b.unpersist()
        return
    cnum = b.where(F.col("value").isNotNull()).select(T.WKEY, "feature", "value", F.col("n").alias("n_cur"))
    ccat = (b.where(F.col("category").isNotNull() & (F.col("feature") != ROWS_FEATURE))
            .select(T.WKEY, "feature", "category", F.col("n").alias("n_cur")))
    records = b.where(F.col("feature") == ROWS_FEATURE).select(T.WKEY, F.col("n").alias("n_records"))
    path = f"{out_dir}/tests/batch_id={tag}"
    T.window_tests(prepared, cnum, ccat).write.mode("overwrite").parquet(path)
    tests = counts.sparkSession.read.parquet(path)
    T.window_verdicts(tests, records, n_features).write.mode("overwrite").parquet(f"{out_dir}/windows/batch_id={tag}")
    b.unpersist()


def flush_open_windows(bounded: DataFrame, prepared: tuple[Reference, list[str], list[str], int], time_col: str, out_dir: str,
                       duration: str = "1 hour") -> None:
    """After a finite stream has ended: close the windows that the watermark left open.

    ``bounded`` is the stream's input as a batch table; only its rows from the end of
    the last window written are read again. A rerun replaces the same folder.
    ``prepared`` comes from ``prepared_reference``.
    """
    spark = bounded.sparkSession
    reference, num, cat, n_features = prepared
    try:
        done = spark.read.parquet(f"{out_dir}/windows").where(f"batch_id <> {FINAL}").agg(F.max(T.WKEY)).first()[0]
    except AnalysisException:  # no window was closed
        done = None
    counts = stream_counts(bounded, time_col, num, cat, duration, "0 seconds")
    if done is not None:
        counts = stream_counts(bounded.where(col(time_col).cast("timestamp") >= F.lit(done)), time_col, num, cat, duration, "0 seconds")
        counts = counts.where(F.col("window.start") > F.lit(done))
    write_windows(counts, reference, n_features, out_dir, str(FINAL))


def start_monitor(spark: SparkSession, stream: DataFrame, prepared: tuple[Reference, list[str], list[str], int], time_col: str,
                  out_dir: str, duration: str = "1 hour", watermark: str = "1 hour",
                  available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Start the monitor; results go to ``<out_dir>/tests`` and ``<out_dir>/windows``.

    ``prepared`` comes from ``prepared_reference``; batches look values up in it and never sort it again."""
    reference, num, cat, n_features = prepared
    counts = stream_counts(stream, time_col, num, cat, duration, watermark)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        write_windows(batch, reference, n_features, out_dir, str(batch_id))

    # one state row per distinct value of an open window: kept on disk, not in the executors' heap
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    writer = (counts.writeStream.outputMode("append").foreachBatch(per_batch)
              .option("checkpointLocation", f"{out_dir}/_checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()


def run_to_completion(spark: SparkSession, stream: DataFrame, reference: DataFrame, time_col: str,
                      feature_cols: Sequence[str], duration: str = "1 hour", watermark: str = "1 hour",
                      out_dir: str | None = None, bounded: DataFrame | None = None) -> str:
    """Process everything available and return the output folder (under the shared checkpoint folder).

    With ``bounded``, the same input as a batch table, windows still open at the end are closed too.
    """
    if out_dir is None:
        base = checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark)
        out_dir = f"{base.rstrip('/')}/window-monitor-{uuid.uuid4().hex[:12]}"
    prepared = prepared_reference(reference, feature_cols)
    q = start_monitor(spark, stream, prepared, time_col, out_dir, duration, watermark)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    if bounded is not None:
        flush_open_windows(bounded, prepared, time_col, out_dir, duration)
    return out_dir


def read_results(spark: SparkSession, out_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tests, windows) written by the monitor; ``batch_id`` is a partition column."""
    return spark.read.parquet(f"{out_dir}/tests"), spark.read.parquet(f"{out_dir}/windows")
