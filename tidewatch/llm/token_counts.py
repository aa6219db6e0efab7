"""Token counts by rank-synchronous merging of ragged arrays.

The distinct pre-tokens of a batch lie in one flat array of symbols. In each round
every pre-token applies its own pair of lowest rank, all places of it at once and all
pre-tokens together; pre-tokens without a pair leave. The symbols that survive are
the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that wait at most before a merge, and distinct ones whose counts a task remembers at most.
WAITING, REMEMBERED = 1 << 20, 200_000
#: No pair: above every rank.
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, others follow 255."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Merges:
    """The merges of a byte-level BPE file as sorted keys of pairs, their ranks and results."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        self.special = [t["content"] for t in model["added_tokens"]]
        self.symbol = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.symbol[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.n = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """The symbols that survive of each of ``tokens``, none of which is empty."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        symbols = self.symbol[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(len(tokens)), sizes)
        ranks = np.full(len(symbols), NONE, np.int32)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[same] = self.rank(symbols[same], symbols[same + 1])
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(ranks, starts)
            out[owner[starts]] = sizes
            going = best < NONE
            if not going.all():  # those without a pair have their count
                keep = np.repeat(going, sizes)
                symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
                sizes, best = sizes[going], best[going]
                if not len(symbols):
                    break
            hit = np.flatnonzero(ranks == np.repeat(best, sizes))
            # a run of one symbol meets its pair at every place: merge every second, from the left
            step = np.arange(len(hit))
            first = np.r_[True, np.diff(hit) != 1]
            hit = hit[(step - np.maximum.accumulate(np.where(first, step, 0))) % 2 == 0]
            symbols[hit] = self.result[ranks[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            merged = hit - np.arange(len(hit))
            symbols, owner, ranks = symbols[keep], owner[keep], ranks[keep]
            # only pairs with a new symbol have a new rank
            left = np.unique(np.r_[merged - 1, merged])
            left = left[left >= 0]
            ranks[left] = NONE
            left = left[left < len(symbols) - 1]
            left = left[owner[left] == owner[left + 1]]
            ranks[left] = self.rank(symbols[left], symbols[left + 1])
        return out


class Counter:
    """Counts tokens of texts, remembering the counts of pre-tokens within a bound."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.split = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, self.merges.special))) if self.merges.special else None
        self.slots: dict[str, int] = {}
        self.counts = np.zeros(0, np.int64)

    def merge(self) -> None:
        """Counts for the pre-tokens that have a slot but none yet."""
        fresh = [t.encode() for t in list(self.slots)[len(self.counts):]]
        if fresh:
            self.counts = np.r_[self.counts, self.merges.count(fresh)]

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        waiting: list[tuple[int, np.ndarray]] = []
        held = 0

        def settle():
            self.merge()
            for i, at in waiting:
                out[i] += self.counts[at].sum()
            waiting.clear()
            if len(self.slots) > REMEMBERED:
                self.slots, self.counts = {}, np.zeros(0, np.int64)

        for i, text in enumerate(texts):
            parts = [text or ""]
            if self.special and self.special.search(parts[0]):
                parts = self.special.split(parts[0])
                out[i] += len(parts) - 1
            for part in parts:
                found = self.split(part)
                slots = self.slots
                waiting.append((i, np.fromiter((slots.setdefault(t, len(slots)) for t in found), np.int64, len(found))))
                held += len(found)
                if held > WAITING or len(slots) > REMEMBERED:
                    settle()
                    held = 0
        settle()
        return out


def count_tokens(docs: DataFrame, limit: int = 512, path: str | None = None, pattern: str | None = None,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every text, counted as a byte-level BPE file gives them.

    ``path`` names the vocabulary (default byte_bpe_50k.json of the public tokenizers) and
    ``pattern`` its pre-token pattern. The strings of special tokens are one token each, no
    others are added. A null text is empty: no bytes, no tokens. Repeated rows and null keys
    are counted each; other columns have no effect. An empty table gives an empty result.
    """
    if path is None:
        import public_tokenizers
        path, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN

    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(path, pattern)
        for texts in batches:
            yield pd.Series(counter(texts.tolist()))

    count = F.pandas_udf(counted, "long")
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    return rows.select(F.col(key), F.octet_length("_t").cast("long").alias("n_bytes"), count("_t").alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
