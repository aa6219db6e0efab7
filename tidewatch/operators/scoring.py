"""Scoring with a fitted linear model given as coefficients.

A logistic model is a projection: margin = w . x + b, probability =
1 / (1 + exp(-margin)); no Python runs per row. Spark ML models are scored
with ``PipelineModel.transform`` in :mod:`tidewatch.operators.models`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.labels import confidence
from tidewatch.operators.columns import col


def margin(weights: Mapping[str, float], intercept: float, present: set[str] | None = None) -> Column:
    """w . x + b; features missing from the frame count as null (P3 reindex semantics)."""
    terms = [F.lit(float(w)) * col(c).cast("double") for c, w in weights.items() if present is None or c in present]
    out = F.lit(float(intercept))
    for t in terms:
        out = out + t
    return out


def logistic_score(df: DataFrame, weights: Mapping[str, float], intercept: float, threshold: float = 0.5,
                   probability: str = "probability", prediction: str = "prediction",
                   conf: str | None = "confidence", digits: int | None = None) -> DataFrame:
    """M6: probability of class 1, the 0/1 prediction at ``threshold`` and the confidence."""
    m = margin(weights, intercept, set(df.columns))
    p = 1.0 / (1.0 + F.exp(-m))
    if digits is not None:
        p = F.round(p, digits)
    out = df.withColumn(probability, p).withColumn(prediction, (F.col(probability) >= threshold).cast("int"))
    if conf:
        out = out.withColumn(conf, confidence(F.col(probability)))
    return out


def score_files(spark: SparkSession, source: str, target: str, weights: Mapping[str, float], intercept: float,
                keys: Mapping[str, str], fmt: str = "csv", threshold: float = 0.5) -> DataFrame:
    """M8: read rows from CSV (with header) or JSON files, score them, write and reread the scores.

    ``keys`` maps the carried columns to their types. Features are read as
    doubles; a column that the files lack, or a value that is no number, is null and
    its row's score too. Every row read is written, with all columns of M6.
    """
    schema = ", ".join([f"`{k}` {t}" for k, t in keys.items()] + [f"`{c}` double" for c in weights])
    if fmt == "csv":
        # by header name, not by position: files may order their columns as they like
        raw = spark.read.option("header", True).csv(source)
        typed = [(col(c) if c in raw.columns else F.lit(None).cast("string")).try_cast(t).alias(c)
                 for c, t in {**keys, **dict.fromkeys(weights, "double")}.items()]
        rows = raw.select(*typed)
    else:
        rows = spark.read.schema(schema).json(source)
    scored = logistic_score(rows, weights, intercept, threshold)
    scored.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)
