"""Explanation records as JSON tables, stored by (aim, model, version)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.columns import attach_row

#: Records in a file, at most.
FILE_RECORDS = 1_000_000

GLOBAL_SCHEMA = ("feature_names array<string>, mean_abs_shap array<double>, std_shap array<double>, base_value double, "
                 "n_background_samples long, generated_at timestamp")


def global_record(importance: DataFrame, base: DataFrame, n_background: DataFrame, aim: str, model: str, version: str) -> DataFrame:
    """One row from X3's (feature, mean_abs, std): parallel arrays in the order of the names.

    ``base`` holds base_value and ``n_background`` n_background_samples, one row each. One row per
    feature comes in, so the arrays are bounded by the number of features.
    """
    entries = importance.agg(F.array_sort(F.collect_list(F.struct("feature", "mean_abs", "std"))).alias("e"))
    row = attach_row(attach_row(entries, base.select("base_value")), n_background.select("n_background_samples"))
    return row.select(F.lit(aim).alias("aim"), F.lit(model).alias("model"), F.lit(version).alias("version"),
                      F.col("e.feature").alias("feature_names"), F.col("e.mean_abs").alias("mean_abs_shap"),
                      F.col("e.std").alias("std_shap"), "base_value", F.col("n_background_samples").cast("long").alias("n_background_samples"),
                      F.current_timestamp().alias("generated_at"))


def instance_records(rows: DataFrame, base: DataFrame, keys: list[str], aim: str, model: str, version: str,
                     threshold: float = 0.5) -> DataFrame:
    """One record per row of X5 (keys, attributions of (feature, phi)): prediction, probability, base
    value and the attributions that are not zero, as a map. Attributions add up to the margin."""
    margin = F.col("base_value") + F.aggregate("attributions", F.lit(0.0), lambda acc, x: acc + x["phi"])
    kept = F.filter("attributions", lambda x: x["phi"] != 0.0)
    p = 1.0 / (1.0 + F.exp(-margin))
    return (attach_row(rows, base.select("base_value")).withColumn("probability", p)
            .select(*keys, F.lit(aim).alias("aim"), F.lit(model).alias("model"), F.lit(version).alias("version"),
                    (F.col("probability") >= threshold).cast("int").alias("prediction"), "probability", "base_value",
                    F.map_from_entries(F.transform(kept, lambda x: F.struct(x["feature"], x["phi"]))).alias("shap_values"),
                    F.transform(kept, lambda x: x["feature"]).alias("feature_names"), F.current_timestamp().alias("generated_at")))


def save_records(records: DataFrame, path: str) -> str:
    """JSON files below aim=/model=/version=; a version written again replaces its old records only.

    Every record repeats the names, so files are compressed (snappy costs little time). A compressed
    file is read by one task, so files have at most FILE_RECORDS records.
    """
    (records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", FILE_RECORDS)
     .partitionBy("aim", "model", "version").json(path, compression="snappy"))
    return path


def load_records(spark: SparkSession, path: str, schema: str, aim: str, model: str, version: str) -> DataFrame:
    """The records of one version; the partition filter reads its files alone."""
    keyed = spark.read.schema(schema + ", aim string, model string, version string").json(path)
    return keyed.where((F.col("aim") == aim) & (F.col("model") == model) & (F.col("version") == version))
