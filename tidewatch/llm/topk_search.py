"""Exact top-k inner products by norm buckets with per-bucket pruning.

Vectors are sorted by length into buckets. The longest vectors give each query a
first bound; a bucket whose longest vector can't reach the bound is never visited.
In a bucket the bound becomes a local cosine threshold: where it is high, ranges of
the query's largest coordinates prune candidates, and lengths do otherwise. What is
left is verified with exact integer products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import written

BUCKET, QUERIES = 2048, 1024   # vectors of a bucket, queries of a block
FOCUS = 4                      # coordinates that prune
HIGH = 0.3                     # local cosine thresholds from here on prune by coordinates
EXACT = 2.0 ** 53
LONG = 2 ** 63 - 1
_SAFE = 1e-9


def usable(vec: Column) -> Column:
    """No null, NaN or infinite component, and not null."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of ``a`` with the vector ``b``; beyond a long they stop at its limits."""
    if not len(a):
        return np.zeros(0, np.int64)
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < EXACT:
        return (a @ b).astype(np.int64)
    whole = [sum(int(x) * int(y) for x, y in zip(row, b, strict=True)) for row in a.tolist()]
    return np.array([max(-LONG - 1, min(LONG, s)) for s in whole], np.int64)


def search_bucket(cand: np.ndarray, norms: np.ndarray, query: np.ndarray, bound: float | None) -> np.ndarray:
    """Positions in the bucket (longest first) that may reach ``bound``; all if it is None."""
    length = float(np.linalg.norm(query))
    if bound is None or bound <= 0 or length == 0:
        return np.arange(len(cand))
    top = float(norms[0]) * length
    if top * (1 + _SAFE) < bound:
        return np.zeros(0, np.int64)
    n = int(np.searchsorted(-norms, -(bound / length) * (1 - _SAFE), side="right"))
    keep = np.arange(n)
    local = min(1.0, bound / top)
    if local >= HIGH:
        unit = query / length
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            x = cand[keep, f] / np.maximum(norms[keep], 1e-300)
            # cos >= local bounds the coordinate by the angles' sum and difference
            angle_q, angle_t = math.acos(max(-1.0, min(1.0, unit[f]))), math.acos(local)
            least = math.cos(min(math.pi, angle_q + angle_t)) - _SAFE
            most = math.cos(max(0.0, angle_q - angle_t)) + _SAFE
            keep = keep[(x >= least) & (x <= most)]
    return keep


def best(ids: np.ndarray, nulls: np.ndarray, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smaller id (null last), then smaller row."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    # -score - 1 keeps the order and fits a long
    order = np.lexsort((rows[near], ids[near], nulls[near], -1 - scores[near]))
    return near[order[:k]]


def run_block(cand: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Best k of the bucket for each query whose bound it may reach."""
    out = []
    for dim, own in cand.groupby("dim"):
        own = own.sort_values(["norm", "row"], ascending=[False, True], kind="stable")
        vecs = unpack(own["vec"].tolist()) if dim else np.zeros((len(own), 0))
        norms, rows = own["norm"].to_numpy(), own["row"].to_numpy()
        nulls = own["id"].isna().to_numpy()
        ids = own["id"].fillna(0).to_numpy(np.int64)
        for q in queries[queries["dim"] == dim].itertuples():
            vec = np.frombuffer(q.vec, np.float64)
            at = search_bucket(vecs, norms, vec, None if pd.isna(q.bound) else float(q.bound))
            at = at[rows[at] != q.row]
            scores = products(vecs[at], vec)
            top = best(ids[at], nulls[at], rows[at], scores, k)
            out.append(pd.DataFrame({"query": q.row, "row": rows[at][top], "score": scores[top]}))
    empty = pd.DataFrame({"query": [], "row": [], "score": []}, dtype="int64")
    return pd.concat(out) if out else empty


def top_products(vectors: DataFrame, queries: str = "id % 100 = 0", k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query row over all other rows.

    Components become floor(scale * x). ``queries`` is a SQL condition on ``id``, the key. Returns
    query_id, rank, key, score; ties go to the smaller key (null last). Null
    vectors and vectors with null or non-finite components take no part; vectors meet
    those of their own dimension; a null key is no query. Repeated rows are candidates
    each. Queries without candidates have no rows. Scores beyond a long stop at its limits.
    """
    def prepare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vecs = [np.floor(scale * np.asarray(v, np.float64)) for v in pdf["v"]]
            yield pd.DataFrame({"row": pdf["row"], "id": pdf["id"], "dim": [len(v) for v in vecs], "vec": [v.tobytes() for v in vecs],
                                "norm": [float(np.linalg.norm(v)) for v in vecs]})

    schema = "row long, id long, dim int, vec binary, norm double"
    rows = (vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
            .where(usable(F.col("v"))))
    rows = written(rows, "topk-rows")  # both of what follows read the same row numbers
    # null keys would turn a batch's keys into floating point: they go round
    known = rows.select("row", "id")
    rows = written(rows.withColumn("id", F.coalesce("id", F.lit(0))).mapInPandas(prepare, schema), "topk-vectors")
    n = rows.count()
    buckets = max(1, math.ceil(n / BUCKET))
    cand = rows.drop("id").join(known, "row")
    sorted_ = cand.repartitionByRange(buckets, F.col("norm").desc(), F.xxhash64("row"))
    cand = written(sorted_.withColumn("bucket", F.spark_partition_id()), "topk-buckets")
    of_query = cand.where(F.col("id").isNotNull() & F.expr(queries))
    top = cand.agg(F.min("bucket").alias("b")).first()["b"]
    lengths = {r["bucket"]: r["m"] for r in cand.groupBy("bucket").agg(F.max("norm").alias("m")).collect()}
    if top is None:
        return cand.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias(key), F.lit(0).cast("long").alias("score")).limit(0)
    # the first bucket, bounded in rows, gives every query its first bound
    first = cand.where(F.col("bucket") == top).orderBy(F.col("norm").desc(), "row").limit(2 * BUCKET).drop("bucket").toPandas()
    order = sorted(lengths)
    reach = np.array([lengths[b] for b in order])

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf = pdf.assign(bound=np.nan)
            hits = run_block(first, pdf, k)
            for q, own in hits.groupby("query"):
                if len(own) >= k:
                    pdf.loc[pdf["row"] == q, "bound"] = float(own["score"].min())
            out = []
            for q in pdf.itertuples():
                length = q.norm * (1 + _SAFE)
                visit = [b for b, m in zip(order, reach, strict=True) if not (q.bound > 0) or m * length >= q.bound]
                out.append(pd.DataFrame({"bucket": visit, "row": q.row, "dim": q.dim, "vec": q.vec, "bound": q.bound}))
            yield pd.concat(out) if out else pd.DataFrame({"bucket": [], "row": [], "dim": [], "vec": [], "bound": []})

    asked = of_query.select("row", "dim", "vec", "norm").mapInPandas(plan, "bucket int, row long, dim int, vec binary, bound double")
    blocks = max(1, math.ceil(of_query.count() / QUERIES))
    asked = written(asked.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")), "topk-asked")
    # a bucket goes to the blocks of queries that ask for it
    wanted = asked.select("bucket", "block").distinct().toDF("_bucket", "_block")
    spread = cand.join(wanted, F.col("bucket") == F.col("_bucket")).drop("bucket").withColumnsRenamed({"_bucket": "bucket", "_block": "block"})
    found = asked.groupBy("bucket", "block").cogroup(spread.groupBy("bucket", "block")).applyInPandas(
        lambda q, c: run_block(c, q, k), "query long, row long, score long")
    names = known.select(F.col("row"), F.col("id"))
    found = found.join(names, "row").join(names.select(F.col("row").alias("query"), F.col("id").alias("query_id")), "query")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row"))
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score"))
