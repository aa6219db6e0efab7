"""Ranked lexical search by MaxScore with bounds of term pairs.

The documents are cut into segments of bounded size. A segment's index holds, for
each term that is asked for, its postings and greatest impact, and for chosen pairs
of terms the documents that hold both and their greatest joint impact. A search takes
a query's terms by falling bound. What the terms still to come can add is bounded by
a matching of their pairs: a pair adds no more than the greatest of its joint impact
and the impacts of each term alone. Once that is below the k-th best sum so far, no
new document can enter; those at hand are probed for the remaining terms and dropped
as soon as their bound is too low. The best k of each segment are merged.

Impacts are integers: with N documents of L terms in all, a term that df documents
hold weighs floor(1000 ln((2N+2)/(2df+1))); a document of n terms has m = 100-b+(b n N div L),
and a term's tf occurrences there score weight * (10^9 tf div (1000 tf + 8 m)), b being 90.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, written

#: A term is a run of ASCII letters and digits and of all letters beyond ASCII, lower-cased A-Z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for UTF-8 bytes: separators become spaces, A-Z lower case.
BYTES = bytes(b if b > 127 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Documents and postings of a segment; distinct terms of a block of queries; pairs each term has with the next by weight.
SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK_TERMS, PARTNERS = 1 << 14, 1 << 21, 1 << 18, 2
#: Pairs that more documents of a segment hold keep their joint maximum alone: such lists skip little.
LIST_DOCS = 1 << 8
LENGTH_SHARE = 90
SEGMENT = "docs binary, sizes binary, has_key binary, terms binary, offsets binary, at binary, tf binary"


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(BYTES).split()


class Segment:
    """Collects documents; postings of the terms asked for, in term order."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.vocabulary = vocabulary
        self.keys, self.sizes, self.terms, self.counts, self.lengths = [], [], [], [], []
        self.postings = 0

    def add(self, key: int | None, text: str | None) -> None:
        words = terms_of(text)
        own = Counter(t for t in map(self.vocabulary.get, words) if t is not None)
        self.keys.append(key)
        self.sizes.append(len(words))
        self.terms.append(np.fromiter(own.keys(), np.int32, len(own)))
        self.counts.append(np.fromiter(own.values(), np.int32, len(own)))
        self.postings += len(own)

    def full(self) -> bool:
        return len(self.keys) >= SEGMENT_DOCS or self.postings >= SEGMENT_POSTINGS

    def row(self) -> tuple:
        held = np.array([len(t) for t in self.terms], np.int64)
        terms, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        at = np.repeat(np.arange(len(held), dtype=np.int32), held)
        order = np.argsort(terms, kind="stable")
        distinct, first = np.unique(terms[order], return_index=True)
        offsets = np.r_[first, len(order)].astype(np.int64)
        keys = np.array([k if k is not None else 0 for k in self.keys], np.int64)
        has = np.array([k is not None for k in self.keys], bool)
        arrays = (keys, np.array(self.sizes, np.int64), has, distinct.astype(np.int32), offsets, at[order], tf[order])
        return tuple(a.tobytes() for a in arrays)


def segments(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """One row a segment: keys and sizes of its documents and postings of ``vocabulary``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SEGMENT.split(", ")]
        open_ = Segment(vocabulary)
        for pdf in batches:
            for k, t in zip(pdf["k"].astype("Int64").tolist() if len(pdf) else [], pdf["t"], strict=True):
                open_.add(None if k is pd.NA else k, t)
                if open_.full():
                    yield pd.DataFrame([open_.row()], columns=columns)
                    open_ = Segment(vocabulary)
        if open_.keys:
            yield pd.DataFrame([open_.row()], columns=columns)

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInPandas(run, SEGMENT)


def statistics(parts: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms, and the documents that hold each term: one row a segment and term is summed."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, total, df = 0, 0, np.zeros(n_terms, np.int64)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, np.int64)
                held, total = held + int((sizes > 0).sum()), total + int(sizes.sum())
                df[np.frombuffer(r.terms, np.int32)] += np.diff(np.frombuffer(r.offsets, np.int64))
        some = np.flatnonzero(df)
        yield pd.DataFrame({"term": np.r_[-1, -2, some], "n": np.r_[held, total, df[some]]})

    rows = (parts.select("sizes", "terms", "offsets").mapInPandas(run, "term int, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())  # one row a term of the block
    sums = {r["term"]: r["n"] for r in rows}
    df = np.zeros(n_terms, np.int64)
    for t, n in sums.items():
        if t >= 0:
            df[t] = n
    return sums.get(-1, 0), sums.get(-2, 0), df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def weighty_pairs(queries: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    """Pairs that get an intersection list: each term of a query with those that follow it by weight."""
    out = set()
    for terms in queries:
        ordered = terms[np.lexsort((terms, -weight[terms]))].tolist()
        for step in range(1, PARTNERS + 1):
            out |= {(min(a, b), max(a, b)) for a, b in zip(ordered, ordered[step:])}
    return np.array(sorted(out), np.int64).reshape(-1, 2)


INDEX = "docs binary, has_key binary, terms binary, offsets binary, at binary, impacts binary, pairs binary, pair_offsets binary, pair_at binary, pair_top binary"


def build_index(parts: DataFrame, n: int, total: int, weight: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Weighted impacts instead of occurrences, and intersection lists with joint impacts, for each segment."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                sizes, terms, offsets = np.frombuffer(r.sizes, np.int64), np.frombuffer(r.terms, np.int32), np.frombuffer(r.offsets, np.int64)
                at, tf = np.frombuffer(r.at, np.int32), np.frombuffer(r.tf, np.int32).astype(np.int64)
                m = 100 - LENGTH_SHARE + LENGTH_SHARE * sizes * n // max(total, 1)
                impacts = np.repeat(weight[terms], np.diff(offsets)) * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
                place = {t: i for i, t in enumerate(terms.tolist())}
                kept, lists, tops, ends = [], [], [], [0]
                for a, b in pairs.tolist():
                    if a in place and b in place:
                        i, j = place[a], place[b]
                        x, y = slice(offsets[i], offsets[i + 1]), slice(offsets[j], offsets[j + 1])
                        both, u, v = np.intersect1d(at[x], at[y], assume_unique=True, return_indices=True)
                        kept.append((a, b))
                        tops.append((impacts[x][u] + impacts[y][v]).max(initial=0))
                        lists.append(both if len(both) <= LIST_DOCS else both[:0])
                        ends.append(ends[-1] + len(lists[-1]))
                none = [np.zeros(0, np.int32)]
                arrays = (np.array(kept, np.int64), np.array(ends, np.int64), np.concatenate(lists or none).astype(np.int32),
                          np.array(tops, np.int64))
                yield pd.DataFrame([(r.docs, r.has_key, r.terms, r.offsets, r.at, impacts.tobytes(), *(a.tobytes() for a in arrays))],
                                   columns=[c.split()[0] for c in INDEX.split(", ")])

    return parts.mapInPandas(run, INDEX)


class Searcher:
    """Top-k search of one segment."""

    def __init__(self, row):
        self.docs, self.has_key = np.frombuffer(row.docs, np.int64), np.frombuffer(row.has_key, bool)
        terms, offsets = np.frombuffer(row.terms, np.int32), np.frombuffer(row.offsets, np.int64)
        at, impacts = np.frombuffer(row.at, np.int32), np.frombuffer(row.impacts, np.int64)
        self.lists = {t: (at[a:b], impacts[a:b]) for t, a, b in zip(terms.tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)}
        self.top = dict(zip(terms.tolist(), np.maximum.reduceat(impacts, offsets[:-1]).tolist(), strict=True)) if len(terms) else {}
        pairs, ends = np.frombuffer(row.pairs, np.int64).reshape(-1, 2), np.frombuffer(row.pair_offsets, np.int64).tolist()
        pair_at, joint = np.frombuffer(row.pair_at, np.int32), np.frombuffer(row.pair_top, np.int64).tolist()
        self.both, self.bound = {}, {}
        for (s, t), a, b, top in zip(pairs.tolist(), ends[:-1], ends[1:], joint, strict=True):
            self.both[s, t] = pair_at[a:b]
            self.bound[s, t] = max(self.top[s], self.top[t], top)
        # equal scores: smaller keys first, those without a key last
        self.place = np.empty(len(self.docs), np.int64)
        self.place[np.lexsort((self.docs, ~self.has_key))] = np.arange(len(self.docs))

    def bounds(self, terms: list[int]) -> list[int]:
        """For each i, what the terms from the i-th on can add: the least of matchings of their pairs made term by term."""
        rest = [0] * (len(terms) + 1)
        for i in range(len(terms) - 1, -1, -1):
            best = rest[i + 1] + self.top[terms[i]]
            # pair the i-th with a later one: all between, and the rest without it, count alone or by their own bounds
            for j in range(i + 1, min(i + 1 + PARTNERS, len(terms))):
                pair = self.bound.get((min(terms[i], terms[j]), max(terms[i], terms[j])))
                if pair is not None:
                    best = min(best, pair + sum(self.top[t] for t in terms[i + 1:j]) + rest[j + 1])
            rest[i] = best
        return rest

    def scores(self, terms: list[int], docs: np.ndarray) -> np.ndarray:
        out = np.zeros(len(docs), np.int64)
        for t in terms:
            out += self.probe(t, docs)
        return out

    def probe(self, term: int, docs: np.ndarray) -> np.ndarray:
        at, impacts = self.lists[term]
        i = np.minimum(np.searchsorted(at, docs), len(at) - 1)
        return np.where(at[i] == docs, impacts[i], 0)

    def search(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of documents, scores) of the k best with a score above 0."""
        terms = [t for t in query.tolist() if self.top.get(t, 0) > 0]
        terms.sort(key=lambda t: (-self.top[t], t))
        if not terms:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rest = self.bounds(terms)
        # the documents of the strongest intersection list give a first k-th best
        strong = max(((self.bound.get((min(a, b), max(a, b)), -1), (min(a, b), max(a, b)))
                      for a, b in zip(terms, terms[1:]) if len(self.both.get((min(a, b), max(a, b)), ()))), default=None)
        least = 0
        if strong:
            seen = self.scores(terms, self.both[strong[1]])
            if len(seen) >= k:
                least = int(np.partition(seen, len(seen) - k)[len(seen) - k])
        sums = np.zeros(len(self.docs), np.int64)
        i = 0
        # documents not met yet can reach the k-th best as long as the rest's bound does
        while i < len(terms) and (rest[i] >= least or not i):
            at, impacts = self.lists[terms[i]]
            sums[at] += impacts
            i += 1
            if i < len(terms) and len(sums) > k:
                least = max(least, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        left = np.flatnonzero(sums)
        own = sums[left]
        while i < len(terms):
            keep = own + rest[i] >= least
            left, own = left[keep], own[keep]
            own = own + self.probe(terms[i], left)
            i += 1
            if len(own) > k:
                least = max(least, int(np.partition(own, len(own) - k)[len(own) - k]))
        best = np.lexsort((self.place[left], -own))[:k]
        return left[best], own[best]


def search(index: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query, key, score): the k best of every segment for each query."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                segment = Searcher(row)
                for number, terms in queries:
                    at, scores = segment.search(terms, k)
                    keys = pd.array(segment.docs[at], "Int64")
                    keys[~segment.has_key[at]] = pd.NA
                    yield pd.DataFrame({"query": np.full(len(at), number), "key": keys, "score": scores})

    return index.mapInPandas(run, "query long, key long, score long")


def query_terms(queries: DataFrame, item: str, text: str) -> DataFrame:
    """(query, item, terms): the distinct terms of each query, queries numbered by row."""
    words = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(TERM), F.lit(0)))
    return queries.select(F.monotonically_increasing_id().alias("query"), F.col(item).alias("item"),
                          F.coalesce(words, F.array().cast("array<string>")).alias("terms"))


def blocks(rows: Iterator) -> Iterator[list[tuple[int, list[str]]]]:
    """Queries in blocks of at most BLOCK_TERMS terms (a query with more is a block of its own)."""
    block, size = [], 0
    for r in rows:
        if block and size + len(r["terms"]) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((r["query"], r["terms"]))
        size += len(r["terms"])
    if block:
        yield block


def ranked(found: DataFrame, by: str, k: int) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), F.asc_nulls_last("key")))


def top_documents(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item, rank, key, score): the k documents with the highest scores above 0 for each row of ``queries``.

    Keys are integers. Equal scores rank by rising key, null keys last. A null text has no terms:
    as a document it is never found, as a query it finds nothing. Repeated documents are found each, and
    repeated queries are answered each with ranks of their own. Other columns have no effect. An empty table on either
    side gives an empty result. Queries go in blocks of at most BLOCK_TERMS terms, which the
    driver and every task hold; for each block all documents are read once.
    """
    spark = docs.sparkSession
    asked = written(query_terms(queries, item, item_text), "search-queries")
    out = None
    for block in blocks(asked.select("query", "terms").toLocalIterator()):
        words = sorted(set(itertools.chain.from_iterable(t for _, t in block)))
        number = {w: i for i, w in enumerate(words)}
        vocabulary = {w.encode(): i for w, i in number.items()}
        ids = [(q, np.array([number[w] for w in t], np.int64)) for q, t in block if t]
        parts = written(segments(docs, vocabulary, key, text), "search-segments")
        n, total, df = statistics(parts, len(words))
        weight = weights(n, df)
        index = written(build_index(parts, n, total, weight, weighty_pairs([t for _, t in ids], weight)), "search-index")
        found = search(index, ids, k)
        found = found.withColumn("rank", ranked(found, "query", k)).where(F.col("rank") <= k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "query long, key long, score long, rank int")
    kind = dict(docs.dtypes)[key]
    return out.join(asked.select("query", "item"), "query").select(
        F.col("item").alias(item), F.col("rank").cast("int").alias("rank"), F.col("key").cast(kind).alias(key), "score")
