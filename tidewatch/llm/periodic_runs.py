"""Periodic runs of words by seeds on diagonals.

A run of period q matches itself q words on, for at least its length less q. Lags
are handled in classes; a class's grams have the least overlap that a run of its lags
guarantees, which is never less than its largest lag. So a run's grams come again one
period later and, as q is the smallest period, not before: the pairs of successive
places of a gram hold a seed of every run, and no other pairs are needed. A seed is
extended along its diagonal; a table of each lag's furthest covered place skips the
seeds of diagonals that are known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a task looks at together; a longer text is looked at alone.
CHUNK = 1 << 18


def numbered_words(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal words of one text, others for other texts; where each text starts."""
    parts, base, starts = [], 0, [0]
    for words in texts:
        seen: dict[bytes, int] = {}
        parts.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + base)
        base += len(seen)
        starts.append(starts[-1] + len(words))
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array(starts, np.int64)


def repeated(places: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """For each of n places the number of its gram, -1 where the gram occurs once."""
    out = np.full(n, -1, np.int64)
    if len(places):
        _, number, counts = np.unique(keys, return_inverse=True, return_counts=True)
        often = counts[number] > 1
        out[places[often]] = number[often]
    return out


def joined(grams: np.ndarray, step: int) -> np.ndarray:
    """Grams that are longer by ``step``: each with the one that starts ``step`` places on."""
    n = len(grams)
    places = np.flatnonzero(grams[:max(0, n - step)] >= 0)
    places = places[grams[places + step] >= 0]
    return repeated(places, grams[places] * n + grams[places + step], n)


def stretch(words: np.ndarray, place: int, lag: int) -> tuple[int, int]:
    """The places around ``place`` whose words come again ``lag`` on: [start, end)."""
    end, step = place, 64
    while end < len(words) - lag:
        top = min(end + step, len(words) - lag)
        differ = words[end:top] != words[end + lag:top + lag]
        if differ.any():
            end += int(differ.argmax())
            break
        end, step = top, step * 2
    start, step = place, 64
    while start > 0:
        low = max(0, start - step)
        differ = words[low:start] != words[low + lag:start + lag]
        if differ.any():
            start -= int(differ[::-1].argmax())
            break
        start, step = low, step * 2
    return start, end


def find_runs(words: np.ndarray, min_length: int, min_periods: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least ``min_length`` words and ``min_periods`` periods.

    Periods of two texts never mix, as their words have other numbers.
    """
    n = len(words)
    counts = np.bincount(words, minlength=1) if n else np.zeros(1, np.int64)
    levels = [np.where(counts[words] > 1, words, -1)]  # grams of 1, 2, 4, ... words
    runs, low = [], 1
    while min_periods * low <= n:
        high = 2 * low - 1
        lags = range(low, high + 1) if low < min_length else [low]
        gram = min(max(min_length, min_periods * q) - q for q in lags)
        level = gram.bit_length() - 1
        while len(levels) <= level:
            levels.append(joined(levels[-1], 1 << len(levels) - 1))
        if low >= min_length and not (levels[level] >= 0).any():
            break
        seeds = joined(levels[level], gram - (1 << level)) if gram > 1 << level else levels[level]
        places = np.flatnonzero(seeds >= 0)
        places = places[np.argsort(seeds[places], kind="stable")]
        lags = np.diff(places)
        ok = (seeds[places[1:]] == seeds[places[:-1]]) & (lags >= low) & (lags <= high)
        keys = np.sort(lags[ok] * n + places[:-1][ok])
        furthest: dict[int, int] = {}
        at = 0
        while at < len(keys):
            lag, place = divmod(int(keys[at]), n)
            if place < furthest.get(lag, 0):
                at = int(np.searchsorted(keys, lag * n + furthest[lag]))
                continue
            start, end = stretch(words, place, lag)
            furthest[lag] = end
            if end - start + lag >= max(min_length, min_periods * lag):
                runs.append((start, end - start + lag, lag))
        low *= 2
    return sorted(runs)


class Finder:
    """Runs and collapsed texts for batches of texts."""

    def __init__(self, min_length: int, min_periods: int):
        self.min_length, self.min_periods = min_length, min_periods

    def chunk(self, texts: list[list[bytes]]) -> list[tuple]:
        words, starts = numbered_words(texts)
        runs = find_runs(words, self.min_length, self.min_periods)
        keep = np.ones(len(words), bool)
        of: dict[int, list[tuple[int, int, int]]] = {}
        for start, length, period in runs:
            keep[start + period:start + length] = False
            doc = int(np.searchsorted(starts, start, side="right")) - 1
            of.setdefault(doc, []).append((start - int(starts[doc]), length, period))
        out = []
        for i, own in enumerate(texts):
            found = of.get(i, [])
            kept = keep[starts[i]:starts[i + 1]]
            left = own if not found else [own[j] for j in np.flatnonzero(kept)]
            out.append(([r[0] for r in found], [r[1] for r in found], [r[2] for r in found], b" ".join(left).decode()))
        return out

    def __call__(self, texts: list[str | None]) -> pd.DataFrame:
        out, held, size = [], [], 0
        for text in texts:
            words = (text or "").encode().split()  # bytes are split at ASCII white space alone
            if held and size + len(words) > CHUNK:
                out += self.chunk(held)
                held, size = [], 0
            held.append(words)
            size += len(words)
        out += self.chunk(held)
        return pd.DataFrame(out, columns=["starts", "lengths", "periods", "collapsed"])


def periodic_runs(docs: DataFrame, min_length: int = 24, min_periods: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, runs, collapsed) of every text.

    ``runs`` are the stretches of consecutive words with a smallest period q and at least
    ``min_length`` words and ``min_periods`` (3 or more) periods that no neighbouring word extends, by
    start, then period: structs of start (word number from 0), length and period. In
    ``collapsed``, words that lie in a run after its first period are dropped, and the others
    are joined by one space. A null or empty text has no runs and an empty ``collapsed``.
    Repeated rows and null keys stay as they are; other columns have no effect. An
    empty table gives an empty result.
    """
    if min_periods < 3 or min_length < 1:
        raise ValueError("grams find every run only where runs have three periods or more")

    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        finder = Finder(min_length, min_periods)
        for texts in batches:
            yield finder(texts.tolist())

    find = F.pandas_udf(found, "starts array<long>, lengths array<long>, periods array<long>, collapsed string")
    rows = docs.select(F.col(key).alias(key), find(F.coalesce(F.col(text), F.lit(""))).alias("_r"))
    run = F.arrays_zip(F.col("_r.starts").alias("start"), F.col("_r.lengths").alias("length"), F.col("_r.periods").alias("period"))
    return rows.select(F.col(key), run.alias("runs"), F.col("_r.collapsed").alias("collapsed"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; ties: smallest start, then period. Null where there is none."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .when(a["period"] != b["period"], F.when(a["period"] < b["period"], -1).otherwise(1)).otherwise(0))
    return F.get(F.array_sort(runs, better), 0)
