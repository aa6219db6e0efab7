"""Hierarchical best-fit packing of documents into sequences.

Groups of pieces are packed by best fit, full and nearly full bins are done, and
the underfull ones become items of the next round, whose groups merge those of the
last; a last round packs what is left by best fit on the counts of each fill, so
no task ever holds more than a group.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import numbered, uniform, written

#: Pieces or bins that one task packs in a round; tokens that may stay free in a nearly full bin.
GROUP, SLACK = 5_000, 2


def vocabulary(name: str = "byte_bpe_50k"):
    """Path of the public tokenizer's ranks."""
    import public_tokenizers
    return public_tokenizers.path(name + ".tiktoken"), public_tokenizers.PATTERN


def load(path: str, pattern: str, end_of_text: int = 50256):
    """The byte-level BPE of byte_bpe_50k.json from the same vocabulary as ranks: equal ids, found faster.

    As there, the text ``<|endoftext|>`` is the special token.
    """
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": end_of_text})


def encode(tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, allowed_special="all") if "<|endoftext|>" in text else tokenizer.encode_ordinary(text)


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole ones of ``capacity``, the first may be shorter."""
    n = len(ids)
    first = n - (math.ceil(n / capacity) - 1) * capacity
    return [(0, first)] + [(i, capacity) for i in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int, separator: int, key: str, text: str) -> DataFrame:
    """The pieces of every document: key, piece, start, length, ids_crc32."""
    path, pattern = vocabulary()
    kind = dict(docs.dtypes)[key]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path, pattern)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                ids = np.array([*encode(tokenizer, t or ""), separator], "<u4")
                out += [(k, i, a, n, zlib.crc32(ids[a:a + n].tobytes())) for i, (a, n) in enumerate(cut(ids, capacity))]
            yield pd.DataFrame(out, columns=["key", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return (rows.mapInPandas(pieces, "key string, piece int, start long, length long, ids_crc32 long")
            .withColumn("key", F.col("key").cast(kind)))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit, largest first: each item's bin and offset, and the bins' fills.

    A bit mask of the room that open bins have finds the least sufficient room at once.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    order = np.argsort(-sizes, kind="stable")
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            rooms[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, np.array(fills, np.int64)


def pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        bins, offsets, fills = best_fit(pdf["size"].to_numpy(), capacity)
        first = pd.Series(pdf["uid"].to_numpy()).groupby(bins).min().to_numpy()
        return pd.DataFrame({"uid": pdf["uid"].to_numpy(), "bin": first[bins], "offset": offsets, "fill": fills[bins]})
    return run


def plan_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of many items of few sizes: (size, first rank, count, first bin, offset) runs.

    Items of a size are numbered by rank; a run puts consecutive ranks into
    consecutive bins. Open bins are kept as runs with equal room.
    """
    rooms: dict[int, list[tuple[int, int]]] = {}
    made, runs = 0, []
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = min((r for r, open_ in rooms.items() if r >= size and open_), default=None)
            if room is None:
                # as many of this size as fit go into each new bin
                per = max(1, capacity // size)
                full, rest = divmod(left, per)
                for j in range(per):
                    if full:
                        runs.append((size, rank + j * full, full, made, j * size))
                if full and capacity - per * size:
                    rooms.setdefault(capacity - per * size, []).append((made, full))
                made, rank = made + full, rank + per * full
                if rest:
                    for j in range(rest):
                        runs.append((size, rank + j, 1, made, j * size))
                    rooms.setdefault(capacity - rest * size, []).append((made, 1))
                    made, rank = made + 1, rank + rest
                left = 0
                continue
            first, n = rooms[room].pop()
            take = min(n, left)
            runs.append((size, rank, take, first, capacity - room))
            if take < n:
                rooms[room].append((first + take, n - take))
            if room > size:
                rooms.setdefault(room - size, []).append((first, take))
            rank, left = rank + take, left - take
    return runs


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """(uid, sequence_id, offset) for pieces (uid, size). Sizes are 1 to ``capacity``."""
    spark = pieces.sparkSession
    items, maps, level = pieces, [], 0
    while True:
        n = items.count()
        groups = max(1, math.ceil(n / GROUP))
        placed = (items.withColumn("group", F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(groups)))
                  .groupBy("group").applyInPandas(pack_group(capacity), "uid long, bin long, offset long, fill long"))
        placed = written(placed, f"pack-round{level}")
        maps.append(placed.select("uid", "bin", "offset"))
        if groups == 1:
            break
        under = placed.where(F.col("fill") < capacity - SLACK).where("uid = bin").select("uid", F.col("fill").alias("size"))
        level += 1
        left = under.count()
        items = under
        if left > n * 0.5 and left > GROUP:  # merging groups again would not make it small: settle by counts
            counts = {int(r["size"]): r["n"] for r in under.groupBy("size").agg(F.count("*").alias("n")).collect()}
            runs = spark.createDataFrame(plan_counts(counts, capacity), "size long, rank long, n long, first long, offset long")
            ranked = numbered(under.withColumn("u", uniform(F.col("uid"))), ["size"], ["uid"], "u", left, "r", len(counts))
            bins = (ranked.join(F.broadcast(runs), "size").where("r >= rank and r < rank + n")
                    .select("uid", (-1 - (F.col("first") + F.col("r") - F.col("rank"))).alias("bin"), "offset"))
            maps.append(written(bins, "pack-counts"))
            break
    out = maps[0].select("uid", F.col("bin").alias("sequence_id"), "offset")
    for m in maps[1:]:
        m = m.select(F.col("uid").alias("sequence_id"), F.col("bin").alias("_bin"), F.col("offset").alias("_base"))
        out = out.join(m, "sequence_id", "left").select(
            "uid", F.coalesce("_bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_base", F.lit(0))).alias("offset"))
    return out


def pack_documents(docs: DataFrame, capacity: int = 1024, separator: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is the separator alone. Repeated rows are packed each. Pieces of full
    length are sequences of their own. An empty table gives an empty result.
    """
    rows = written(token_pieces(docs, capacity, separator, key, text).withColumn("uid", F.monotonically_increasing_id()), "pack-pieces")
    short = pack(rows.where(F.col("length") < capacity).select("uid", F.col("length").alias("size")), capacity)
    out = rows.join(short, "uid", "left")
    return out.select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32",
                      F.coalesce("sequence_id", "uid").alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
