"""Session construction and shared settings.

Library code never creates folders on its own: checkpoints go to the shared
folder named by ``spark.checkpoint.dir``. Only local runs (tests, bench) set
one, and only when the session has none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # broadcast only what the planner can size; explicit hints are used only
    # for tables whose row count is bounded by the number of features.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tidewatch", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, or None."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    jsc = spark.sparkContext._jsc
    opt = jsc.sc().getCheckpointDir()
    return opt.get() if opt.isDefined() else None


def ensure_local_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder; where a local session names none, one below its warehouse.

    A cluster has to name one: its warehouse may be a folder of the driver's machine.
    """
    d = checkpoint_dir(spark)
    if d is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    Never a local checkpoint: an executor loss would lose the blocks.
    """
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage by a table: written to the shared folder and read back.

    Unlike a cache it holds no memory, and unlike a checkpoint its columns are read apart.
    """
    spark = df.sparkSession
    base = checkpoint_dir(spark) or ensure_local_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def materialize(df: DataFrame) -> DataFrame:
    """Persist and fill the cache now (one job).

    Used for aggregated intermediates that several later stages read: with AQE
    those stages start concurrently, and a cache that is only declared would be
    rebuilt by each of them.
    """
    df = df.persist()
    df.count()
    return df
