"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs are gathered over all training texts, quantised on a
log scale, and stored as (n-gram, 1), ..., (n-gram, q) in Bloom filters that are
broadcast. A count is read by probing with rising q until a probe fails. Pair
probabilities use absolute discounting; the weight left for single words is stored
the same way, quantised, for each context.

The broadcast filters have at most ``max_bytes``. They hold the frequencies from a
least count on, the smallest power of two with which all entries fit. What is rarer
stays in tables, quantised the same way, and parts of the documents ask for it in packed
questions that move once to the chunks of the tables, whose packed answers move back to
the part: the model grows with the corpus, its broadcast part does not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import one_row_each, written

LOG_BASE = 1.25          # of quantised counts
WEIGHT_BASE = 1.05       # of quantised weights
BITS_PER_ENTRY, PROBES = 12, 7
MAX_FILTER_BYTES = 64 << 20
FREQUENT = 2e-6          # words with at least this share of all tokens (at most 500,000) have their counts broadcast
TOKENS = 150_000         # tokens that a task works on at once
REMEMBERED = 400_000     # words whose quanta a task remembers
HELD = 1_000_000         # keys that a task holds before it sums and sends them
CHUNK_KEYS = 1 << 18     # keys of a chunk of counts, about
ROW_KEYS = 1 << 12       # keys in a row of counts, at most
BATCH_BYTES = 2 << 20    # that Python workers get at once; what they work out of it takes several times as much
SENT_BYTES = 1 << 20     # that they send at once, about, as the JVM holds a whole batch outside its heap
SCANNED_ROWS = 128       # that a scan holds at once, as rows of counts have some 64 KB
SLOTS = 128              # slots of chunks whose counts a task holds at once to answer questions, at least, of SLOT_CHUNKS
SLOT_CHUNKS = 4, 16      # chunks of a slot, at least and at most
TASK_CHUNKS = 48         # chunks whose questions a task answers, about
PASSES = 3               # shares of the documents that ask one after another, so that the disk holds the questions of one
ASKED = 1 << 18          # questions of a part of the documents, about, and documents, at most
PIECE = 1 << 15          # entries of a row that tells what a part's answers are for
KEY_BYTES = {1: 8, 2: 6, 3: 4}  # of a word's hash, a pair's, within its slot, and a context's, in questions
ANSWER_BYTES = {1: 4, 2: 1, 3: 1}  # of a word's count and a pair's and a weight's quanta
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64


END = xxhash.xxh64_intdigest(b"")
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_P1, _P2, _P3, _P4, _P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return x << U(by) | x >> U(64 - by)


def xxh64(data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the slices of ``data``: those under 32 bytes together, step by step, longer ones by the library."""
    padded = data + bytes(8)
    at = lambda kind: np.ndarray(len(padded) - 7, kind, padded, strides=(1,))  # noqa: E731  (a number at each byte)
    h = _P5 + size.astype(U)
    with np.errstate(over="ignore"):
        for k in range(3):
            own = np.flatnonzero(size >= 8 * k + 8)
            lane = at("<u8")[start[own] + 8 * k]
            h[own] = rotated(h[own] ^ rotated(lane * _P2, 31) * _P1, 27) * _P1 + _P4
        own = np.flatnonzero(size & 4)
        h[own] = rotated(h[own] ^ at("<u4")[start[own] + (size[own] & -8)].astype(U) * _P1, 23) * _P2 + _P3
        for k in range(3):
            own = np.flatnonzero((size & 3) > k)
            h[own] = rotated(h[own] ^ at("u1")[start[own] + (size[own] & -4) + k].astype(U) * _P5, 11) * _P1
        h = (h ^ h >> U(33)) * _P2
        h = (h ^ h >> U(29)) * _P3
        h ^= h >> U(32)
    for i in np.flatnonzero(size >= 32).tolist():
        h[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + size[i]])
    return h


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, END after each text (in UTF-8), and the texts' token counts."""
    data = b" ".join([t or b"" for t in texts]).translate(_LOWER)
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]])
    start, end = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T
    ends = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64)  # where the next text begins
    until = np.searchsorted(start, ends)
    lengths = np.diff(until, prepend=0) + 1
    last = np.cumsum(lengths) - 1
    h = np.full(len(start) + len(texts), END, U)
    word = np.ones(len(h), bool)
    word[last] = False
    h[word] = xxh64(data, start, end - start)
    return h, lengths


def sent(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some SENT_BYTES."""
    rows = max(1, batch.num_rows * SENT_BYTES // max(1, batch.nbytes))
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def batches_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of some TOKENS tokens, by the bytes of ``text``."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // (TOKENS * 6))) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return (batch.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Context and word in one key, 32 bits each; a text begins after END."""
    return pair_key(np.concatenate([np.array([END], U), h[:-1]]) if len(h) else h, h)


def pair_key(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (before >> U(32) << U(32)) | (h & U(0xFFFFFFFF))


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser: well-mixed bits of key and salt."""
    with np.errstate(over="ignore"):
        x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def chunk_of(keys: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(keys, 0) >> U(20)) % U(chunks)


def by_chunk(keys: np.ndarray, values: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(chunk, keys, values) with the keys' bytes, for chunks that have any."""
    chunk = chunk_of(keys, chunks).astype(np.int32)
    order = np.argsort(chunk, kind="stable")
    keys, values = keys[order], values[order]
    edges = np.searchsorted(chunk[order], np.arange(chunks + 1))
    for c in np.flatnonzero(np.diff(edges)).tolist():
        part = slice(edges[c], edges[c + 1])
        yield c, keys[part].tobytes(), values[part].tobytes()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def joined(blobs: pd.Series) -> np.ndarray:
    """The longs of all blobs."""
    return np.frombuffer(b"".join(blobs), np.int64)


def packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value: first all lowest bytes, then the next ones (alike bytes compress)."""
    size = 4 if width <= 4 else 8
    return np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, :width].T).tobytes()


def unpacked(blobs: list[bytes], width: int) -> np.ndarray:
    size = 4 if width <= 4 else 8
    out, at = np.zeros((sum(map(len, blobs)) // width, size), np.uint8), 0
    for b in blobs:
        n = len(b) // width
        out[at:at + n, :width] = np.frombuffer(b, np.uint8).reshape(width, n).T
        at += n
    return out.reshape(-1).view(f"<u{size}")


def short(keys: np.ndarray, kind: int) -> np.ndarray:
    """What is left of keys in KEY_BYTES: words and contexts as they are, of pairs (32 bits of each word) a hash that doesn't depend on the chunk's."""
    return mix(keys, 3) & U((1 << 8 * KEY_BYTES[kind]) - 1) if kind == 2 else keys


def record(columns: list[np.ndarray], widths: list[int]) -> bytes:
    """The columns packed and compressed (Zstandard), behind their length; small numbers take less than what shuffles make of them."""
    data = b"".join(packed(c, w) for c, w in zip(columns, widths, strict=True))
    return len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def fields(records: list[bytes], widths: list[int]) -> list[np.ndarray]:
    """The columns of all records."""
    blobs = [pa.decompress(r[4:], int.from_bytes(r[:4], "little"), "zstd", asbytes=True) for r in records]
    out, at, each = [], 0, [len(b) // sum(widths) for b in blobs]
    for w in widths:
        out.append(unpacked([b[at * n:(at + w) * n] for b, n in zip(blobs, each, strict=True)], w))
        at += w
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_alone(df: DataFrame, label: str) -> DataFrame:
    """``written``, with the shuffle files behind the table removed at once, not when the driver next collects its garbage."""
    with setting(df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        return written(df, label)


def tables(docs: DataFrame, chunks: int, rarest_pair: int) -> DataFrame:
    """(kind, chunk, keys, counts, singles, doubles, types, tokens): summed counts by chunk, in rows of at most ROW_KEYS.

    Kind 1 are words, kind 2 pairs; of pairs seen less than ``rarest_pair`` times only
    numbers are kept. ``docs`` has text. Tasks sum what they read before it moves.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {1: [], 2: []}, 0

        def out() -> pa.RecordBatch:
            rows = []
            for kind, got in held.items():
                keys, counts = summed(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))
                got.clear()
                rows += [(kind, c, a, b) for c, a, b in by_chunk(keys, counts.astype(np.uint32), chunks)]
            kinds, numbers, keys, counts = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                                              names=["kind", "chunk", "keys", "counts"])

        for batch in parts:
            for part in batches_of(batch):
                h, _ = hashed(part.column("text").to_pylist())
                for kind, keys in ((1, h), (2, pair_keys(h))):
                    k, c = np.unique(keys, return_counts=True)
                    held[kind].append((k, c.astype(np.int32)))
                    n += len(k)
                if n > HELD:
                    yield from sent(out())
                    n = 0
        if n:
            yield from sent(out())

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(pdf["kind"].iloc[0])
        keys, counts = summed(np.frombuffer(b"".join(pdf["keys"]), U), np.frombuffer(b"".join(pdf["counts"]), np.uint32).astype(np.int64))
        keep = slice(None) if kind == 1 else counts >= rarest_pair
        numbers = int((counts == 1).sum()), int((counts == 2).sum()), len(keys), int(counts.sum())
        keys, counts, chunk = keys[keep], counts[keep], int(pdf["chunk"].iloc[0])
        return pd.DataFrame([(kind, chunk, keys[i:i + ROW_KEYS].tobytes(), counts[i:i + ROW_KEYS].tobytes(), *(numbers if i == 0 else (0, 0, 0, 0)))
                             for i in range(0, max(1, len(keys)), ROW_KEYS)],
                            columns=["kind", "chunk", "keys", "counts", "singles", "doubles", "types", "tokens"])

    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "kind int, chunk int, keys binary, counts binary")
    return rows.groupBy("kind", "chunk").applyInPandas(
        merge, "kind int, chunk int, keys binary, counts binary, singles long, doubles long, types long, tokens long")


def quantised(counts: np.ndarray, least: float, base: float = LOG_BASE) -> np.ndarray:
    """1 + floor(log(count / least)); count >= least."""
    return 1 + np.floor(np.log(np.maximum(counts / least, 1)) / math.log(base) + 1e-9).astype(np.int64)


def value(q: np.ndarray, least: float) -> np.ndarray:
    """Least count of quantum q, 0 for q = 0."""
    return np.where(q > 0, least * LOG_BASE ** (q - 1.0), 0.0)


class Filter:
    """A log-frequency Bloom filter in chunks of equal size, addressed by key."""

    def __init__(self, chunks: int, bits: int, data: np.ndarray | None = None, top: int = 255):
        self.chunks, self.bits, self.data, self.top = chunks, bits, data, top

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each key, from which all its probes follow, and the first bit of its chunk."""
        x = mix(keys, 0)
        with np.errstate(over="ignore"):
            return x * U(0xD6E8FEB86659FD93), (x << U(32) | x >> U(32)) | U(1), (x >> U(20)) % U(self.chunks) * U(self.bits)

    def place(self, one: np.ndarray, two: np.ndarray, q: int | np.ndarray, i: int) -> np.ndarray:
        """Bit inside the chunk of the i-th probe for quantum q: double hashing, scaled to the chunk's size."""
        step = (q * PROBES + i).astype(U) if isinstance(q, np.ndarray) else U(PROBES * q + i)
        with np.errstate(over="ignore"):
            return ((one + step * two) >> U(32)) * U(self.bits) >> U(32)

    def build(self, keys: np.ndarray, q: np.ndarray) -> bytes:
        """The chunk that holds these keys."""
        flags = np.zeros(self.bits, bool)
        one, two, _ = self.probe(keys)
        for level in range(1, int(q.max(initial=0)) + 1):
            own = q >= level
            for i in range(PROBES):
                flags[self.place(one[own], two[own], level, i)] = True
        return np.packbits(flags, bitorder="little").tobytes()

    def holds(self, one: np.ndarray, two: np.ndarray, first: np.ndarray, level: int | np.ndarray) -> np.ndarray:
        """Membership of (key, level): all probes of what its first probe leaves."""
        def hit(one, two, first, level, i):
            at = self.place(one, two, level, i) + first
            return (self.data.take((at >> U(3)).view(np.int64)) >> (at.astype(np.uint8) & np.uint8(7))) & np.uint8(1) == 1

        out = hit(one, two, first, level, 0)
        left = np.flatnonzero(out)
        one, two, first, level = one[left], two[left], first[left], level[left] if isinstance(level, np.ndarray) else level
        ok = np.ones(len(left), bool)
        for i in range(1, PROBES):
            ok &= hit(one, two, first, level, i)
        out[left] = ok
        return out

    def read(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts by repeated membership probes.

        A count's levels are nested, so the last one is found by doubling and halving steps; it
        must have the level below it too, else the search goes on below.
        """
        q = np.zeros(len(keys), np.int64)
        if self.data is None or not len(self.data):
            return q
        one, two, first = self.probe(keys)
        open_ = np.argsort((first // U(self.bits) % U(1 << 16)).astype(np.uint16), kind="stable")  # a chunk's keys together, as its bits are
        one, two, first = one[open_], two[open_], first[open_]
        have = np.flatnonzero(self.holds(one, two, first, 1))
        open_, one, two, first = open_[have], one[have], two[have], first[have]
        q[open_] = 1
        low, high = np.ones(len(open_), np.int64), np.full(len(open_), self.top + 1)
        while len(open_):
            level = np.minimum(2 * low, (low + high) // 2)
            ok = self.holds(one, two, first, level)
            low, high = np.where(ok, level, low), np.where(ok, high, level)
            done = high - low <= 1
            if not done.any():
                continue
            at = np.flatnonzero(done)
            q[open_[at]] = low[at]
            at = at[low[at] > 2]
            wrong = at[~self.holds(one[at], two[at], first[at], low[at] - 1)]
            high[wrong], low[wrong], done[wrong] = low[wrong], 1, False
            going = ~done
            open_, one, two, first, low, high = open_[going], one[going], two[going], first[going], low[going], high[going]
        return q


def least_count(entries: dict[int, int], floor: int, max_bytes: int) -> int:
    """Smallest power of two, from ``floor``, with which quantised counts fit.

    ``entries`` has, for each power of two, the entries of counts in [2^i, 2^(i+1)) if
    all of them are kept; leaving lower ones out also lowers the rest's quanta, so
    this is an upper bound.
    """
    power = floor.bit_length() - 1
    while sum(n for i, n in entries.items() if i >= power) * BITS_PER_ENTRY / 8 > max_bytes:
        power += 1
    return 1 << power


def build_filter(entries: DataFrame, total: int, spark) -> Filter:
    """A filter from (chunk, keys, quanta) blobs; ``total`` entries. Bounded by the bytes that least_count kept to."""
    chunks = entries.agg(F.max("chunk").alias("c")).first()["c"]
    if chunks is None:
        return Filter(1, 8)
    size = Filter(chunks + 1, max(64, math.ceil(total * BITS_PER_ENTRY * 1.02 / (chunks + 1) / 8) * 8))

    def bits(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, q = np.frombuffer(b"".join(pdf["keys"]), U), np.frombuffer(b"".join(pdf["quanta"]), np.uint8)
        return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "bits": [size.build(keys, q.astype(np.int64))], "top": [int(q.max(initial=0))]})

    size.data, size.top = np.zeros(size.chunks * size.bits // 8, np.uint8), 1
    for r in entries.groupBy("chunk").applyInPandas(bits, "chunk int, bits binary, top int").toLocalIterator():
        size.top = max(size.top, r["top"])
        size.data[r["chunk"] * size.bits // 8:(r["chunk"] + 1) * size.bits // 8] = np.frombuffer(r["bits"], np.uint8)
    return size


def single_of(q: np.ndarray, least: float, tokens: int, types: int) -> np.ndarray:
    """Add-one probability of a word of quantum q."""
    return (value(q, least) + 1) / (tokens + types + 1)


class Known:
    """What the filters said of words, up to REMEMBERED of them."""

    def __init__(self):
        self.words, self.values = np.zeros(0, U), np.zeros((2, 0), np.int64)

    def __call__(self, words: np.ndarray, read) -> np.ndarray:
        """``read`` of the distinct, sorted ``words``: only those not known are read."""
        at = np.minimum(np.searchsorted(self.words, words), max(0, len(self.words) - 1))
        have = self.words[at] == words if len(self.words) else np.zeros(len(words), bool)
        out = np.empty((2, len(words)), np.int64)
        out[:, have] = self.values[:, at[have]]
        new = words[~have]
        out[:, ~have] = read(new)
        if len(self.words) + len(new) > REMEMBERED:
            self.__init__()
        place = np.searchsorted(self.words, new)
        self.words, self.values = np.insert(self.words, place, new), np.insert(self.values, place, out[:, ~have], axis=1)
        return out


class Model:
    """The filters and totals that score a text; ``rest`` tells of which kinds (1 words, 2 pairs, 3 weights) some are in the tables alone."""

    def __init__(self, words: Filter, pairs: Filter, weights: Filter, least: dict[int, int], discount: float, tokens: int, types: int, rest: frozenset):
        self.words, self.pairs, self.weights, self.least, self.rest = words, pairs, weights, least, rest
        self.discount, self.tokens, self.types = discount, tokens, types

    def quanta(self, words: np.ndarray) -> np.ndarray:
        """Quantised counts of words and weights of them as contexts."""
        return np.stack([self.words.read(words), self.weights.read(words >> U(32))])

    def log10(self, words: np.ndarray, to: np.ndarray, of: np.ndarray, known: Known) -> tuple[np.ndarray, ...]:
        """log10 probability of the words ``of`` after the words ``to``, places in ``words``, which are distinct hashes.

        Also the pairs for which the tables have to be asked, and what the filters say of them: four quanta of 8 bits, of the
        pair, the word before, the word and the weight; then the words whose counts and those whose weights are open.
        """
        qw, qg = known(words, self.quanta)
        single = single_of(qw, self.least[1], self.tokens, self.types)
        share = np.where(qw > 0, LOG_BASE ** -qw.astype(float) / self.least[1], 0.0)
        gamma = WEIGHT_BASE ** -qg.astype(float)
        q = self.pairs.read(pair_key(words[to], words[of]))
        seen = np.maximum(value(np.arange(q.max(initial=0) + 1), self.least[2]) - self.discount, 0)[q]
        p = np.log10(np.minimum(seen * share[to] + gamma[to] * single[of], 1.0))
        rare = {1: qw == 0, 2: q == 0, 3: qg == 0}
        rare = {kind: r if kind in self.rest else np.zeros_like(r) for kind, r in rare.items()}
        if 1 not in self.rest:  # a filter of all words misses none, and pairs with words it doesn't hold weren't seen
            rare[2] &= (qw[of] > 0) & (qw[to] > 0)
        ask = np.flatnonzero(rare[1][of] | rare[1][to] | rare[2] | rare[3][to])
        to, of = to[ask], of[ask]
        return p, ask, ((q[ask] << 8 | qw[to]) << 8 | qw[of]) << 8 | qg[to], rare[1], rare[3]


def train(docs: DataFrame, max_bytes: int = MAX_FILTER_BYTES, rarest_pair: int = 2) -> tuple[Model, DataFrame]:
    """The model, and (h, c): the exact count of every word's hash, from the texts in ``docs``."""
    return trained(docs, max_bytes, rarest_pair)[:2]


def trained(docs: DataFrame, max_bytes: int, rarest_pair: int) -> tuple[Model, DataFrame, DataFrame, DataFrame]:
    """The model, (h, c) of all words, and what the filters leave out: (pair, c) of pairs and (ctx, q) of weights."""
    return fitted(docs, max_bytes, rarest_pair)[:4]


def fitted(docs: DataFrame, max_bytes: int, rarest_pair: int) -> tuple[Model, DataFrame, DataFrame, DataFrame, DataFrame, int]:
    """What ``trained`` returns, the counts by chunk as ``tables`` has them, and the number of chunks."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    chunks = max(1, math.ceil(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // (6 * CHUNK_KEYS) + 1)
    counts = written_alone(tables(docs, chunks, rarest_pair), "lm-counts")
    stats = {r["kind"]: r for r in counts.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("singles", "doubles", "types", "tokens")]).collect()}
    tokens, types = (stats[1]["tokens"], stats[1]["types"]) if 1 in stats else (0, 0)
    once, twice = (stats[2]["singles"], stats[2]["doubles"]) if 2 in stats else (0, 0)
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))

    def powers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for kind, blobs in pdf.groupby("kind")["counts"]:
                c = joined(blobs)
                power = np.floor(np.log2(np.maximum(c, 1)) + 1e-9).astype(np.int64)
                n = np.bincount(power, weights=quantised(c, float(rarest_pair) if kind == 2 else 1.0))
                yield pd.DataFrame({"kind": kind, "power": np.arange(len(n)), "n": n.astype(np.int64)})

    entries: dict[int, dict[int, int]] = {1: {}, 2: {}}
    for r in counts.select("kind", "counts").mapInPandas(powers, "kind int, power int, n long").groupBy("kind", "power").agg(F.sum("n").alias("n")).collect():
        entries[r["kind"]][r["power"]] = r["n"]
    # words and weights come first, as every pair needs them; a pair that is left out asks its table once
    word_least = least_count(entries[1], 1, max_bytes * 3 // 8)
    # a pair's context is at least as frequent as the pair, so it is in the words' filter
    least = {1: word_least, 2: max(word_least, least_count(entries[2], rarest_pair, max_bytes // 8))}
    taken = sum(n for kind, levels in entries.items() for i, n in levels.items() if 1 << i >= least[kind]) * BITS_PER_ENTRY // 8

    def quanta(kind: int):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                out = []
                for chunk, k, c in zip(pdf["chunk"], pdf["keys"], pdf["counts"], strict=True):
                    keys, n = np.frombuffer(k, U), np.frombuffer(c, np.int64)
                    keep = n >= least[kind]
                    out.append((chunk, keys[keep].tobytes(), np.minimum(quantised(n[keep], least[kind]), 255).astype(np.uint8).tobytes()))
                yield pd.DataFrame(out, columns=["chunk", "keys", "quanta"])
        return run

    blobs = "chunk int, keys binary, quanta binary"
    of = lambda kind: counts.where(F.col("kind") == kind).mapInPandas(quanta(kind), blobs)
    size = lambda kind: sum(n for i, n in entries[kind].items() if 1 << i >= least[kind])
    words, pairs = build_filter(of(1), size(1), spark), build_filter(of(2), size(2), spark)

    def tiered(n: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Quanta, and the counts they start from: the filters' least count, or 1 for what only the tables have."""
        start = np.where(n >= least[kind], float(least[kind]), 1.0)
        return quantised(n, start), start

    def contexts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            ctx, at = np.unique(joined(pdf["keys"]).view(U) >> U(32), return_inverse=True)
            kept = np.bincount(at, weights=np.maximum(value(*tiered(joined(pdf["counts"]), 2)) - discount, 0), minlength=len(ctx))
            yield pd.DataFrame({"ctx": ctx.view(np.int64), "kept": kept, "total": np.nan, "n": 0})

    def totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            keys, n = joined(pdf["keys"]).view(U), joined(pdf["counts"])
            keep = n >= rarest_pair
            q, start = tiered(n[keep], 1)
            yield pd.DataFrame({"ctx": (keys[keep] >> U(32)).view(np.int64), "kept": 0.0, "total": start * LOG_BASE ** q.astype(float), "n": n[keep]})

    both = (counts.where("kind = 2").mapInPandas(contexts, "ctx long, kept double, total double, n long")
            .union(counts.where("kind = 1").mapInPandas(totals, "ctx long, kept double, total double, n long")))
    rate = F.col("kept") / F.col("total")
    left = (both.groupBy("ctx").agg(F.sum("kept").alias("kept"), F.min(F.when(~F.isnan("total"), F.col("total"))).alias("total"), F.max("n").alias("n"))
            .where("kept > 0 and total > 0")
            .select("ctx", F.ceil(-F.log(F.greatest(F.lit(1e-5), 1 - rate)) / math.log(WEIGHT_BASE)).cast("int").alias("q"), "n").where("q > 0"))
    # weights take entries in units of WEIGHT_BASE; those of rare contexts stay in the table if they don't fit
    left = written_alone(left, "lm-weights")
    weight_entries = {r["power"]: r["q"] for r in left.groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power")).agg(F.sum("q").alias("q")).collect()}
    least[3] = least_count(weight_entries, 1, max_bytes - taken)
    total_q = sum(q for i, q in weight_entries.items() if 1 << i >= least[3])

    def weight_blobs(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame(list(by_chunk(pdf["ctx"].to_numpy(np.int64).view(U), pdf["q"].to_numpy().astype(np.uint8), chunks)), columns=["chunk", "keys", "quanta"])

    weights = build_filter(left.where(F.col("n") >= least[3]).mapInPandas(weight_blobs, blobs), total_q, spark)

    def rows(below: float, count: str):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                keys, n = joined(pdf["keys"]), joined(pdf["counts"])
                keep = n < below
                yield pd.DataFrame({count: keys[keep], "c": n[keep]})
        return run

    exact = counts.where("kind = 1").select("keys", "counts").mapInPandas(rows(math.inf, "h"), "h long, c long")
    rare_pairs = counts.where("kind = 2").select("keys", "counts").mapInPandas(rows(least[2], "pair"), "pair long, c long")
    rest = frozenset([kind for kind in (1, 2) if any(1 << i < least[kind] and n for i, n in entries[kind].items())]
                     + [3] * any(1 << i < least[3] for i in weight_entries))
    return (Model(words, pairs, weights, least, discount, tokens, types, rest), exact, rare_pairs,
            left.where(F.col("n") < least[3]).select("ctx", "q"), counts, chunks)


QUESTION = {"slot": pa.int32(), "kind": pa.int32(), "part": pa.int64(), "first": pa.int64(), "data": pa.binary()}
DOCUMENT = {"key": pa.string(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "score": pa.float64()}
NAMES = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary"}
#: What is in ``data`` beside questions and answers (kinds 1 to 3): which words documents count, which pairs they have, what
#: is known of these, and the questions for the counts and weights of their words.
COUNTED, PAIRED, TERMS, OPEN = 4, 5, 6, 7
FIELDS = {COUNTED: [4, 4, 4], PAIRED: [4, 4, 4], TERMS: [4], OPEN: [4, 4, 4]}


def schema_of(columns: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{c} {NAMES[t]}" for c, t in columns.items())


def rows_of(n: int, columns: dict[str, pa.DataType], **values) -> pa.RecordBatch:
    """n rows; columns without values are null."""
    return pa.RecordBatch.from_arrays([pa.array(values[c], t) if isinstance(values.get(c), (np.ndarray, list)) else values.get(c, pa.nulls(n, t))
                                       for c, t in columns.items()], names=list(columns))


def slot_chunks(chunks: int) -> int:
    """Chunks of a slot: slots grow with the model to their full size first, then they become more."""
    return min(SLOT_CHUNKS[1], max(SLOT_CHUNKS[0], chunks // SLOTS))


def slot_of(keys: np.ndarray, chunks: int) -> np.ndarray:
    return (chunk_of(keys, chunks) // U(slot_chunks(chunks))).astype(np.int32)


class Part:
    """What a part of the documents asks the tables, and what the answers are for, until it is sent.

    Every key that a batch needs is asked once. A question's number is its place by slot, so answers need no keys.
    """

    def __init__(self, name: int):
        self.name, self.documents = name, 0
        self.keys: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
        self.asked = {1: 0, 2: 0, 3: 0}
        self.terms: list[np.ndarray] = []
        self.uses: dict[int, list[np.ndarray]] = {1: [], 2: []}

    def ask(self, kind: int, keys: np.ndarray) -> np.ndarray:
        """The numbers of questions, from 1."""
        self.keys[kind].append(keys)
        self.asked[kind] += len(keys)
        return np.arange(self.asked[kind] - len(keys) + 1, self.asked[kind] + 1)

    def use(self, kind: int, number: np.ndarray, doc: np.ndarray, documents: int) -> None:
        """How often each of ``documents`` more documents needs an answer."""
        code, times = np.unique(number * documents + doc, return_counts=True)
        number, doc = np.divmod(code, documents)
        self.uses[kind].append(np.stack([number - 1, doc + self.documents, times]).astype(np.uint32))

    def full(self) -> bool:
        return max(sum(self.asked.values()), self.documents) >= ASKED

    def rows(self, chunks: int) -> Iterator[pa.RecordBatch]:
        """Rows of QUESTION, one for each slot and kind, and what they are for in pieces."""
        if not any(self.asked.values()):
            return
        rows, rank, order = [], {}, {}
        for kind, keys in self.keys.items():
            keys = np.concatenate([*keys, np.zeros(0, U)])
            slot = slot_of(keys, chunks)
            order[kind] = np.argsort(slot.astype(np.uint16) if slot.max(initial=0) < 1 << 16 else slot, kind="stable")
            rank[kind] = np.empty(len(keys) + 1, np.int64)
            rank[kind][0], rank[kind][order[kind] + 1] = 0, np.arange(1, len(keys) + 1)
            keys, slot = short(keys[order[kind]], kind), slot[order[kind]]
            edges = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot)).tolist()
            rows += [(int(slot[a]), kind, self.name, a, packed(keys[a:b], KEY_BYTES[kind])) for a, b in zip(edges, edges[1:], strict=False)]
        said = []
        for kind, what in ((1, COUNTED), (2, PAIRED)):
            if self.uses[kind]:
                number, doc, times = np.concatenate(self.uses[kind], axis=1)
                number = rank[kind][number + 1]
                by = np.argsort(number, kind="stable")
                said.append((what, [np.diff(number[by], prepend=0), doc[by], times[by]]))
        if self.terms:
            terms, word, before, weight = np.concatenate(self.terms, axis=1)[:, order[2]]
            said.append((TERMS, [terms]))
            if word.any() or before.any() or weight.any():
                said.append((OPEN, [rank[1][word], rank[1][before], rank[3][weight]]))
        for what, columns in said:
            at = np.arange(0, len(columns[0]), PIECE)
            rows += [(slot, what, self.name, i, record([c[i:i + PIECE] for c in columns], FIELDS[what]))
                     for i, slot in zip(at.tolist(), slot_of((at + self.name).view(U), chunks).tolist(), strict=True)]
        yield from sent(rows_of(len(rows), QUESTION | DOCUMENT, **{c: list(v) for c, v in zip(QUESTION, zip(*rows, strict=True), strict=True)}))


def answers(asked: DataFrame, counts: DataFrame, rare_weights: DataFrame | None, below: dict[int, float], model: Model, chunks: int) -> DataFrame:
    """The documents of ``asked`` (kind 0), with what the answers to its questions add.

    ``asked`` has the columns of QUESTION and DOCUMENT. The words (kind 1) and pairs (kind 2) with counts under ``below``
    and the weights left to the tables (kind 3) meet the questions for them slot by slot: a task holds the values of one
    slot and kind at a time. Answers have the numbers of their questions and move back to the part that asked.
    """
    spark = asked.sparkSession
    out_columns = {c: t for c, t in (QUESTION | DOCUMENT).items() if c != "slot"}
    total, discount, least, kinds = float(model.tokens + model.types + 1), model.discount, dict(model.least), len(KEY_BYTES)
    tokens, types = model.tokens, model.types
    quantum = np.minimum(quantised(np.maximum(np.arange(1 << 16), 1), 1.0), 255).astype(np.uint8)

    def quanta(c: np.ndarray) -> np.ndarray:
        return quantum[c] if c.max(initial=0) < len(quantum) else np.minimum(quantised(c, 1.0), 255)

    def table(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for kind, chunk, k, c in zip(*(batch.column(x).to_pylist() for x in ("kind", "chunk", "keys", "counts")), strict=True):
                n = np.frombuffer(c, np.int64)
                keep = n < below[kind]
                if keep.any():
                    keys, n = short(np.frombuffer(k, U)[keep], kind), n[keep]
                    rows.append((chunk // slot_chunks(chunks), kind, -1, 0, record([keys, quanta(n) if kind == 2 else n], [KEY_BYTES[kind], ANSWER_BYTES[kind]])))
            if rows:
                yield from sent(rows_of(len(rows), QUESTION, **{c: list(v) for c, v in zip(QUESTION, zip(*rows, strict=True), strict=True)}))

    def weights(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            ctx, q = batch.column("ctx").to_numpy().view(U), batch.column("q").to_numpy()
            slot = slot_of(ctx, chunks)
            order = np.argsort(slot, kind="stable")
            ctx, q, slot = ctx[order], q[order], slot[order]
            edges = np.append(np.flatnonzero(np.diff(slot, prepend=-1)), len(slot)).tolist()
            data = [record([ctx[a:b], q[a:b]], [KEY_BYTES[3], ANSWER_BYTES[3]]) for a, b in zip(edges, edges[1:], strict=False)]
            n = len(data)
            yield from sent(rows_of(n, QUESTION, slot=slot[edges[:-1]], kind=np.full(n, 3), part=np.full(n, -1), first=np.zeros(n, np.int64), data=data))

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, values, parts_of_table = None, None, None, []
        for batch in parts:
            kind, slot, part, first = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("kind", "slot", "part", "first"))
            through = (kind == 0) | (kind > kinds)
            if through.any():
                yield from sent(batch.filter(pa.array(through)).select(list(out_columns)))
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(kind) != 0) | (np.diff(slot) != 0) | (np.diff(part < 0) != 0)])).tolist()
            for a, b in zip(edges, [*edges[1:], len(kind)], strict=True):
                k = int(kind[a])
                if through[a]:
                    continue
                blobs = batch.column("data").slice(a, b - a).to_pylist()
                if now != (k, slot[a]):
                    now, keys, parts_of_table = (k, slot[a]), None, []
                if part[a] < 0:
                    parts_of_table.append(fields(blobs, [KEY_BYTES[k], ANSWER_BYTES[k]]))
                    continue
                if keys is None:
                    keys, values = (np.concatenate(x) for x in zip(*parts_of_table, strict=True)) if parts_of_table else (np.zeros(0, U), np.zeros(0, U))
                    order, parts_of_table = np.argsort(keys), []
                    keys, values = keys[order], values[order].astype(f"<u{ANSWER_BYTES[k]}")
                wanted = unpacked(blobs, KEY_BYTES[k])
                order = np.argsort(wanted)
                at = np.empty(len(order), np.int64)
                at[order] = np.searchsorted(keys, wanted[order])
                at = np.minimum(at, max(0, len(keys) - 1))
                found = np.where(keys[at] == wanted, values[at], 0).astype(values.dtype) if len(keys) else np.zeros(len(at), f"<u{ANSWER_BYTES[k]}")
                ends = np.cumsum([0, *(len(x) // KEY_BYTES[k] * ANSWER_BYTES[k] for x in blobs)]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(found.tobytes())])
                yield from sent(rows_of(b - a, out_columns, kind=kind[a:b], part=part[a:b], first=first[a:b], data=data))

    share = np.concatenate([[0.0], LOG_BASE ** -np.arange(1.0, 256)])
    single = single_of(np.arange(256), least[1], tokens, types)
    rare_single = single_of(np.arange(256), 1.0, tokens, types)
    gamma = WEIGHT_BASE ** -np.arange(256.0)
    seen = np.maximum(value(np.arange(256), least[2]) - discount, 0)
    rare_seen = np.maximum(value(np.arange(256), 1.0) - discount, 0)

    def sums(n: int, got: dict[int, list[bytes]]) -> Iterator[np.ndarray]:
        """What n documents add to n_known, base and score."""
        counted, pair, weight = (np.frombuffer(b"".join(got[k]), f"<u{ANSWER_BYTES[k]}") for k in (1, 2, 3))
        number, doc, times = fields(got[COUNTED], FIELDS[COUNTED])
        c = counted[np.cumsum(number, dtype=np.int64) - 1].astype(np.int64)
        yield np.bincount(doc, np.where(c > 0, times, 0), n)
        yield np.bincount(doc, times * np.log10((c + 1) / total), n)
        q = fields(got[TERMS], FIELDS[TERMS])[0].view(np.uint8).reshape(-1, 4).T
        before, after, left = share[q[2]] / least[1], single[q[1]], gamma[q[0]]
        if got[OPEN]:
            of, to, ctx = fields(got[OPEN], FIELDS[OPEN])
            words = np.concatenate([[0], np.where(counted > 0, quanta(np.maximum(counted, 1).astype(np.int64)), 0)])
            before, after = np.where(to > 0, share[words[to]], before), np.where(of > 0, rare_single[words[of]], after)
            left = np.where(ctx > 0, gamma[np.concatenate([[0], weight])[ctx]], left)
        p = np.log10(np.minimum(np.where(q[3] > 0, seen[q[3]], rare_seen[pair]) * before + left * after, 1.0))
        number, doc, times = fields(got[PAIRED], FIELDS[PAIRED])
        yield np.bincount(doc, times * p[np.cumsum(number, dtype=np.int64) - 1], n)

    def finish(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, got = None, [], {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(own).combine_chunks().to_batches()[0]
            if any(got.values()):
                known, base, score = sums(rows.num_rows, got)
                add = {"n_known": np.rint(known).astype(np.int64), "base": base, "score": score}
                rows = rows_of(rows.num_rows, DOCUMENT, **{c: rows.column(c).to_numpy() + add[c] if c in add else rows.column(c) for c in DOCUMENT})
            return sent(rows)

        for batch in parts:
            kind, part = (batch.column(x).to_numpy() for x in ("kind", "part"))
            edges = np.flatnonzero(np.concatenate([[True], (np.diff(kind) != 0) | (np.diff(part) != 0)])).tolist()
            for a, b in zip(edges, [*edges[1:], len(kind)], strict=True):
                if now != part[a]:
                    if own:
                        yield from out()
                    now, own, got = part[a], [], {k: [] for k in range(1, OPEN + 1)}
                if kind[a]:
                    got[int(kind[a])] += batch.column("data").slice(a, b - a).to_pylist()
                else:
                    own.append(batch.slice(a, b - a).select(list(DOCUMENT)))
        if own:
            yield from out()

    both = asked.unionByName(counts.select("kind", "chunk", "keys", "counts").mapInArrow(table, schema_of(QUESTION)), allowMissingColumns=True)
    if rare_weights is not None:
        both = both.unionByName(rare_weights.mapInArrow(weights, schema_of(QUESTION)), allowMissingColumns=True)
    slots = math.ceil(chunks / slot_chunks(chunks))
    tasks = max(min(slots, 2 * spark.sparkContext.defaultParallelism), chunks // TASK_CHUNKS)
    back = both.repartition(tasks, "slot").sortWithinPartitions("slot", "kind", "part").mapInArrow(answer, schema_of(out_columns))
    return back.repartition(tasks, "part").sortWithinPartitions("part", "kind", "first").mapInArrow(finish, schema_of(DOCUMENT))


def score_texts(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_FILTER_BYTES,
                rarest_pair: int = 2) -> DataFrame:
    """Scores of every document under a model of the ``training`` rows (of one text column).

    Returns key, n_tokens, n_known, train_tokens, base_score (add-one unigram, exact
    counts) and score (the filter model). Words are compared by 64-bit hashes. Null and
    empty texts have the end token alone; repeated rows are scored alike; without
    training rows all counts are 0. Where the filters hold all, words too rare for the
    broadcast table of exact counts meet their counts in a join, one row for each document
    and rare word. Else parts of the documents ask for these, and for counts and weights that
    the filters leave open, in packed rows, in PASSES shares whose scores are written before the next share asks.
    The model has the pairs seen at least ``rarest_pair`` times.
    """
    with setting(docs.sparkSession, "spark.sql.parquet.columnarReaderBatchSize", str(SCANNED_ROWS)):
        return scored_texts(docs, training, key, text, max_bytes, rarest_pair)


def scored_texts(docs: DataFrame, training: DataFrame, key: str, text: str, max_bytes: int, rarest_pair: int) -> DataFrame:
    """What ``score_texts`` returns."""
    spark = docs.sparkSession
    model, exact, _, rare_weights, counts, chunks = fitted(training.select(F.col(text).alias("text")), max_bytes, rarest_pair)
    asking = bool(model.rest)
    if not asking:  # packed questions meet the counts by chunk
        exact = written(exact, "lm-words")
    at_least = max(1.0, FREQUENT * model.tokens)
    often = exact.where(F.col("c") >= at_least).toPandas()
    often_h, order = np.unique(often["h"].to_numpy(np.int64).view(U), return_index=True)
    shared = spark.sparkContext.broadcast((model, often_h, often["c"].to_numpy(np.int64)[order]))
    below = model.tokens + model.types + 1
    kind = dict(docs.dtypes)[key]
    everything = model.types == len(often_h)
    columns = QUESTION | DOCUMENT if asking else {"row": pa.int64()} | DOCUMENT | {"h": pa.int64(), "tf": pa.int32()}

    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, frequent, count = shared.value
        known, asked = Known(), None
        for batch in parts:
            for part in batches_of(batch):
                row = part.column("row").to_numpy(zero_copy_only=False)
                h, n = hashed(part.column("text").to_pylist())
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                words, at = np.unique(h, return_inverse=True)
                before = np.concatenate([[np.searchsorted(words, U(END))], at[:-1]])
                pairs, place_of = np.unique(before * len(words) + at, return_inverse=True)
                to, of = np.divmod(pairs, len(words))
                p, ask, terms, rare, light = m.log10(words, to, of, known)
                p[ask] = 0.0
                place = np.minimum(np.searchsorted(frequent, words), max(0, len(frequent) - 1))
                have = (frequent[place] == words) if len(frequent) else np.zeros(len(words), bool)
                c = np.where(have, count[place], 0) if len(frequent) else np.zeros(len(words), np.int64)
                base = np.log10((c + 1) / below)
                if not everything:
                    base[~have] = 0.0
                hit = have[at]
                own = {"key": part.column("key"), "n_tokens": n, "n_known": np.add.reduceat(hit.astype(np.int64), first),
                       "base": np.add.reduceat(base[at], first), "score": np.add.reduceat(p[place_of], first)}
                doc = np.repeat(np.arange(len(n)), n)
                if asking:
                    # each batch asks once for each word without a known count, for each pair that the filters leave open and its words
                    asked = asked or Part(int(row[0]))
                    yield rows_of(len(n), columns, slot=slot_of(row.view(U), chunks), kind=np.zeros(len(n), np.int64),
                                  part=np.full(len(n), asked.name), first=asked.documents + np.arange(len(n)), **own)
                    counted, weighed, open_ = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64)
                    need = rare if everything else rare | ~have
                    counted[need], weighed[light] = asked.ask(1, words[need]), asked.ask(3, words[light] >> U(32))
                    to, of = to[ask], of[ask]
                    open_[ask] = asked.ask(2, pair_key(words[to], words[of]))
                    asked.terms.append(np.stack([terms, counted[of] * rare[of], counted[to] * rare[to], weighed[to]]).astype(np.uint32))
                    if not everything:
                        asked.use(1, counted[at[~hit]], doc[~hit], len(n))
                    number = open_[place_of]
                    asked.use(2, number[number > 0], doc[number > 0], len(n))
                    asked.documents += len(n)
                    if asked.full():
                        yield from asked.rows(chunks)
                        asked = None
                    continue
                zero = np.zeros(len(n), np.int64)
                yield rows_of(len(n), columns, row=row, h=mix(row.view(U), 7).view(np.int64), tf=zero, **own)
                if not everything:
                    # rare words: one row for each document and word
                    code, tf = np.unique(doc[~hit] * len(words) + at[~hit], return_counts=True)
                    if len(code):
                        d, r = np.divmod(code, len(words))
                        zero = np.zeros(len(code), np.int64)
                        yield rows_of(len(code), columns, row=row[d], h=words[r].view(np.int64), tf=tf, n_tokens=zero, n_known=zero, base=zero, score=zero)
        if asked:
            yield from asked.rows(chunks)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("string").alias("key"), F.col(text).cast("binary").alias("text"))
    train_tokens = F.lit(model.tokens).cast("long").alias("train_tokens")
    if asking:
        # a plan that may give other rows when it runs again is asked at once
        passes, out = PASSES if one_row_each(docs) else 1, None
        below_of = {1: max(at_least, model.least[1]), 2: model.least[2]}
        for i in range(passes):
            own = rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(passes)) == i) if passes > 1 else rows
            scored = answers(own.mapInArrow(score, schema_of(columns)), counts, rare_weights if 3 in model.rest else None, below_of, model, chunks)
            scored = written_alone(scored.select(F.col("key").cast(kind).alias(key), "n_tokens", "n_known", train_tokens, F.col("base").alias("base_score"), "score"), "lm-scores")
            out = scored if out is None else out.unionByName(scored)
        return out
    found = rows.mapInArrow(score, schema_of(columns))
    rare = exact.where(F.col("c") < at_least)
    c = F.coalesce(F.col("c"), F.lit(0))
    parts = found.join(rare, "h", "left").select("row", "key", "n_tokens", (F.col("n_known") + F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("n_known"),
                                                 (F.col("base") + F.col("tf") * F.log10((c + 1) / F.lit(float(below)))).alias("base"), "score")
    out = parts.groupBy("row").agg(
        F.max("key").alias("_key"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select(F.col("_key").cast(kind).alias(key), "n_tokens", "n_known", train_tokens, "base_score", "score")
