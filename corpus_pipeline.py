"""From raw documents to packed sequences: quality rules, near-duplicates, personal data, mixing, packing.

Each stage reads what its predecessor wrote as Parquet. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import mixing, packing, pii, quality_rules, simhash_dedup
from tidewatch.llm.common import written

#: No SQL engine has the tokenizer, XXH64 fingerprints and md5-seeded streams together: tested against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled rules reject go; thresholds come from all labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("key"), "quality")
    return quality_rules.keep_good(docs, labels)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest doc_id."""
    return simhash_dedup.keep_one(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a block's edge may cut a document."""
    return mixing.mixed_documents(docs).withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of the mixed documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", dedup), ("pii", private), ("mixing", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
