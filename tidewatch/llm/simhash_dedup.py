"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits. For a link
at distance tau, a query may give partition i a threshold t_i as long as the
thresholds add up to tau - parts + 1 (-1 leaves a partition out): any fingerprint
within tau bits then lies within t_i in some partition. Dynamic programming picks
the cheapest thresholds for each fingerprint from the counts of its own partition
values, the fingerprint probes those values, and full distances verify.

Where even the cheapest allocation costs more than probing the ball of radius 1 of
the whole fingerprint (values shared by very many fingerprints), that ball is used:
two fingerprints within 2 bits share a point of their balls, and all that share a
point are within 2 bits, so a point links them as a star and no pairs are made. If
only one of two fingerprints uses its ball, the other's probes find the link.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewatch.llm.common import identified, written
from tidewatch.llm.components import components

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Estimated work from which a fingerprint uses its ball of radius 1: that of its 65 points, and of what it shares them with.
BALL_COST = 2 * (BITS + 1)
_BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles, repeats included; bit set if set in over half of them."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts, ends[shingle - 1:].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[i:i + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, out: str, shingle: int, seed: int = 42) -> DataFrame:
    """Add the fingerprint as a signed long."""
    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t or "", shingle, seed) for t in texts], np.uint64).view(np.int64))
    return docs.withColumn(out, of(F.col(text)))


def bit_groups(prints: DataFrame, parts: int) -> list[list[int]]:
    """Partitions of equal size with correlated bits together, from the counts of all fingerprints.

    Partitions take turns: each adds the free bit with the highest mean absolute
    correlation to the bits it has.
    """
    def counts(batches):
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for pdf in batches:
            bits = np.unpackbits(pdf["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            yield pd.DataFrame({"i": np.arange(BITS * BITS + 1), "n": np.append(total.ravel(), n)})

    rows = prints.mapInPandas(counts, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    if not rows:
        return [list(range(k, BITS, parts)) for k in range(parts)]
    flat = np.zeros(BITS * BITS + 1)
    for r in rows:
        flat[r["i"]] = r["n"]
    n, joint = max(flat[-1], 1), flat[:-1].reshape(BITS, BITS)
    p = np.diag(joint) / n
    sd = np.sqrt(p * (1 - p))
    corr = np.abs((joint / n - np.outer(p, p)) / np.maximum(np.outer(sd, sd), 1e-9))
    sizes = [BITS // parts + (k < BITS % parts) for k in range(parts)]
    free, groups = set(range(BITS)), [[] for _ in range(parts)]
    while free:
        for k in range(parts):
            if len(groups[k]) < sizes[k]:
                bit = max(sorted(free), key=lambda b: corr[b, groups[k]].mean() if groups[k] else -corr[b].mean())
                groups[k].append(bit)
                free.remove(bit)
    return [sorted(g) for g in groups]


def part_values(fp: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Value of each partition's bits, one column a partition."""
    u = fp.view(np.uint64)
    out = np.zeros((len(u), len(groups)), np.int64)
    for k, bits in enumerate(groups):
        for j, b in enumerate(bits):
            out[:, k] |= (((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)).astype(np.int64)
    return out


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` bits."""
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]


def allocate(costs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest thresholds by dynamic programming over partitions.

    costs[q, i, t + 1]: estimated work of query q with threshold t in partition i.
    Returns each query's thresholds (summing to ``budget``) and their cost.
    """
    q, parts, levels = costs.shape
    low, high = -parts, budget + parts
    best = np.full((parts + 1, q, high - low + 1), np.inf)
    best[0, :, -low] = 0
    choice = np.zeros((parts, q, high - low + 1), np.int8)
    for i in range(parts):
        for t in range(-1, levels - 1):
            shifted = np.full((q, high - low + 1), np.inf)
            if t < 0:
                shifted[:, :-1] = best[i][:, 1:]
            else:
                shifted[:, t:] = best[i][:, : high - low + 1 - t]
            shifted += costs[:, i, t + 1][:, None]
            better = shifted < best[i + 1]
            best[i + 1][better] = shifted[better]
            choice[i][better] = t
    at = np.full(q, budget - low)
    cost = best[parts][np.arange(q), at]
    out = np.zeros((q, parts), np.int8)
    for i in reversed(range(parts)):
        out[:, i] = choice[i][np.arange(q), at]
        at = at - out[:, i]
    return out, cost


def links(prints: DataFrame, distance: int = 2, parts: int = 3) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``distance`` bits.

    ``prints`` has distinct ``fp``. Every such pair is joined by an edge or through
    edges of fingerprints within the distance of each other; no other edges are made.
    """
    if distance != 2:
        raise ValueError("the ball of radius 1 links fingerprints at a distance of 2")
    groups = bit_groups(prints, parts)
    radius = distance - parts + 1 + (parts - 1)
    masks = [[ball(len(g), r) for r in range(radius + 1)] for g in groups]

    def index(batches):
        for pdf in batches:
            values = part_values(pdf["fp"].to_numpy(np.int64), groups)
            yield pd.DataFrame({"fp": np.tile(pdf["fp"].to_numpy(np.int64), parts), "part": np.repeat(np.arange(parts, dtype=np.int32), len(pdf)), "value": values.T.ravel()})

    indexed = written(prints.mapInPandas(index, "fp long, part int, value long"), "simhash-index")
    filled = indexed.groupBy("part", "value").agg(F.count("*").alias("n"))
    mean = {r["part"]: r["m"] for r in filled.groupBy("part").agg(F.avg("n").alias("m")).collect()}
    spread = {r["part"]: r["v"] for r in filled.groupBy("part").agg(F.count("*").alias("v")).collect()}
    wide = indexed.join(filled, ["part", "value"]).groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == k, F.col("n"))).alias(f"n{k}") for k in range(parts)])
    most = BALL_COST

    def probe(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            costs = np.zeros((len(fp), parts, radius + 2))
            for k, g in enumerate(groups):
                share = min(1.0, spread[k] / 2.0 ** len(g))
                own = pdf[f"n{k}"].to_numpy(np.float64)
                for t in range(radius + 1):
                    others = len(masks[k][t]) - 1
                    costs[:, k, t + 1] = 1 + own + others * (1 + share * mean[k])
            t, cost = allocate(costs, distance - parts + 1)
            values = part_values(fp, groups)
            star = cost > most
            out = []
            for k in range(parts):
                for r in range(radius + 1):
                    pick = ~star & (t[:, k] == r)
                    m = np.array(masks[k][r], np.int64)
                    out.append(pd.DataFrame({"fp": np.repeat(fp[pick], len(m)), "part": np.int32(k), "value": (values[pick, k][:, None] ^ m[None, :]).ravel()}))
            m = np.array([0] + [1 << b for b in range(BITS)], np.uint64)
            out.append(pd.DataFrame({"fp": np.repeat(fp[star], len(m)), "part": np.int32(-1), "value": (fp[star].view(np.uint64)[:, None] ^ m[None, :]).ravel().view(np.int64)}))
            yield pd.concat(out)

    probes = written(wide.mapInPandas(probe, "fp long, part int, value long"), "simhash-probes")
    pairs = (probes.where("part >= 0").join(indexed.select(F.col("fp").alias("other"), "part", "value"), ["part", "value"])
             .where("fp <> other").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance)
             .select(F.col("fp").alias("a"), F.col("other").alias("b")))
    balls = probes.where("part < 0")
    star = balls.groupBy("value").agg(F.min("fp").alias("b")).join(balls.select(F.col("fp").alias("a"), "value"), "value").where("a <> b").select("a", "b")
    return pairs.union(star)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """Fingerprint and component of every document.

    Returns row (the column ``row``, or a number of its own), key, fp (signed), fingerprint (16 hex digits), leader (the
    component's smallest key) and component_id (the same). Null and empty texts have
    the fingerprint zero and link like any other; null keys belong to their component
    but name it only where it has no other key. Texts of fewer words than a shingle
    hash whole. Repeated rows share a component. Equal fingerprints meet as one, so
    groups of copies make no pairs.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(key).alias("key"), F.col(text).alias("_text"))
    rows = written(fingerprints(rows, "_text", "fp", shingle).drop("_text"), "simhash-rows")
    prints = written(rows.groupBy("fp").agg(F.min("key").alias("first")), "simhash-prints")
    found = components(links(prints.select("fp"), distance))
    grouped = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    leaders = grouped.groupBy("group").agg(F.min("first").alias("leader"))
    by_print = written(grouped.join(leaders, "group").select("fp", "group", "leader"), "simhash-groups")
    return rows.join(by_print, "fp").select("row", F.col("key").alias(key), "fp", "group", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("leader").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each component: that of the smallest key, then the first read.

    All columns stay as they are, whatever their names.
    """
    docs = identified(docs, "simhash-documents")
    found = near_duplicates(docs.select("row", F.col("own")[key].alias("key"), F.col("own")[text].alias("text")), shingle, distance, "key", "text", "row")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("row"))).alias("m")).select(F.col("m.row").alias("row"))
    return docs.join(first, "row", "left_semi").select("own.*")


