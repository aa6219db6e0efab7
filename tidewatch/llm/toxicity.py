"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

The labels mark documents, so labelled tokens are derived: in toxic training documents
the words whose document frequencies speak for toxicity are tagged, in others none.
The field has two states; a token's features are the evidence levels of its word and
of its neighbours. Forward-backward marginals give the offending spans and, through
a calibrated logistic function of their summary, the document's score.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD

#: Bounds on the labelled documents that the model is fitted on, toxic and others; drawn by hash.
MAX_TOXIC, MAX_OTHER = 1500, 3000
_WORD = re.compile(WORD)
_STRIP = "\"'()[]{}<>.,;:!?*_-"
EDGES = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)  # of a word's evidence
LEVELS = len(EDGES) + 2                                 # and one for unknown words
TAG = 3.0                                               # evidence from which a word of a toxic document is tagged
PREFIXES = (3, 4, 5, 6)                                 # letters of the word beginnings that carry evidence too
CELLS = 1_000_000                                       # padded tokens of a block


def normal(words: list[str]) -> list[str]:
    return [w.lower().strip(_STRIP) for w in words]


def marks(word: str) -> list[str]:
    """A word and its beginnings: inflected and compound words share these."""
    return [word, *[f"{word[:k]}~" for k in PREFIXES if len(word) >= k]]


def frequencies(texts: list[list[str]], toxic: np.ndarray) -> dict[str, list[int]]:
    """Toxic and other documents of each mark."""
    out: dict[str, list[int]] = {}
    for words, t in zip(texts, toxic.tolist(), strict=True):
        for m in {m for w in set(words) for m in marks(w)}:
            out.setdefault(m, [0, 0])[1 - t] += 1
    return out


def evidence(counts: dict[str, list[int]], n_yes: int, n_no: int, own: tuple[int, int] = (0, 0)) -> dict[str, int]:
    """Evidence level of each mark in three documents or more.

    Log ratio of document frequencies, less (or plus) one standard error towards 0.
    ``own`` is taken from the counts: (1, 0) gives the levels for a toxic document's
    own words as if it were not in the sample, (0, 1) for any other's.
    """
    out, n_yes, n_no = {}, n_yes - own[0], n_no - own[1]
    for w, (a, b) in counts.items():
        a, b = max(0, a - own[0]), max(0, b - own[1])
        if a + b >= 3:
            ratio = math.log((a + 0.5) / (n_yes + 1)) - math.log((b + 0.5) / (n_no + 1))
            error = math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            score = max(0.0, ratio - error) if ratio > 0 else min(-1e-9, ratio + error)
            out[w] = bisect.bisect_right(EDGES, score) + 1
    return out


class Levels(dict):
    """Evidence level of raw words: the highest of their marks, 0 where none is known; emptied when it gets large."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        get = self.known.get
        level = self[word] = max(get(m, 0) for m in marks(word.lower().strip(_STRIP)))
        return level


def blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Documents by falling length, in blocks of about CELLS padded tokens."""
    order = np.argsort(-lengths, kind="stable")
    i = 0
    while i < len(order):
        n = max(1, CELLS // max(1, int(lengths[order[i]])))
        yield order[i:i + n]
        i += n


def padded(levels: list[np.ndarray], block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels as tokens x documents (0 beyond the end) and the number of documents that reach each token."""
    n = np.array([len(levels[i]) for i in block])
    out = np.zeros((int(n.max(initial=0)), len(block)), np.int8)
    for j, i in enumerate(block):
        out[:n[j], j] = levels[i]
    active = np.searchsorted(-n, -np.arange(1, len(out) + 1), side="right")
    return out, active


def around(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels before and after each token; 0 beyond a document's ends."""
    none = np.zeros((1, levels.shape[1]), levels.dtype)
    return np.concatenate([none, levels[:-1]]), np.concatenate([levels[1:], none])


class Field:
    """Two states; weights of the tag state for the levels here, before and after, and of the transitions."""

    def __init__(self):
        self.w = np.zeros((3, LEVELS))
        self.start, self.move = 0.0, np.zeros((2, 2))

    def emission(self, levels: np.ndarray) -> np.ndarray:
        before, after = around(levels)
        return np.exp(np.clip(self.w[0][levels] + self.w[1][before] + self.w[2][after], -30, 30))

    def marginals(self, levels: np.ndarray, active: np.ndarray, pairs: bool = False):
        """P(tag) of every token (and summed pair marginals) by forward-backward."""
        psi, move = self.emission(levels), np.exp(self.move)
        steps, docs = levels.shape
        fwd = np.zeros((steps, docs))  # P(state 1 | tokens so far), from which both messages follow
        for t in range(steps):
            n = active[t]
            if t == 0:
                one, zero = psi[0, :n] * math.exp(self.start), np.ones(n)
            else:
                p = fwd[t - 1, :n]
                one = psi[t, :n] * ((1 - p) * move[0, 1] + p * move[1, 1])
                zero = (1 - p) * move[0, 0] + p * move[1, 0]
            fwd[t, :n] = one / (one + zero)
        out, back = np.zeros((steps, docs)), np.full(docs, 0.5)
        both = np.zeros((2, 2))
        for t in range(steps - 1, -1, -1):
            n = active[t]
            if t + 1 < steps:
                m = active[t + 1]
                one, zero = psi[t + 1, :m] * back[:m], 1 - back[:m]
                b1, b0 = move[1, 0] * zero + move[1, 1] * one, move[0, 0] * zero + move[0, 1] * one
                if pairs:
                    p = fwd[t, :m]
                    cell = np.array([[(1 - p) * move[0, 0] * zero, (1 - p) * move[0, 1] * one], [p * move[1, 0] * zero, p * move[1, 1] * one]])
                    both += (cell / cell.sum(axis=(0, 1))).sum(axis=2)
                back[:m] = b1 / (b1 + b0)
            p, b = fwd[t, :n], back[:n]
            out[t, :n] = p * b / (p * b + (1 - p) * (1 - b))
        return (out, both) if pairs else out

    def fit(self, levels: list[np.ndarray], tags: list[np.ndarray], rounds: int = 80, rate: float = 0.4, ridge: float = 1.0) -> Field:
        """Gradient ascent (Adam) on the likelihood of the tags, with a ridge penalty."""
        lengths = np.array([len(x) for x in levels])
        work = []
        for block in blocks(lengths):
            if lengths[block[0]]:
                lev, active = padded(levels, block)
                work.append((lev, active, padded(tags, block)[0].astype(np.float64)))
        size = 3 * LEVELS + 5
        x, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
        x[:LEVELS] = -1.0
        total = max(1, int(lengths.sum()))
        for step in range(1, rounds + 1):
            self.w, self.start, self.move = x[:3 * LEVELS].reshape(3, LEVELS), x[-5], x[-4:].reshape(2, 2)
            g = np.zeros(size)
            for lev, active, tag in work:
                p, both = self.marginals(lev, active, pairs=True)
                diff = tag - p
                live = np.arange(lev.shape[1])[None, :] < active[:, None]
                diff *= live
                for k, near in enumerate((lev, *around(lev))):
                    g[k * LEVELS:(k + 1) * LEVELS] += np.bincount(near.ravel(), weights=diff.ravel(), minlength=LEVELS)
                g[-5] += diff[0].sum()
                a, b, on = tag[:-1], tag[1:], live[1:]
                seen = np.array([[((1 - a) * (1 - b) * on).sum(), ((1 - a) * b * on).sum()], [(a * (1 - b) * on).sum(), (a * b * on).sum()]])
                g[-4:] += (seen - both).ravel()
            g = (g - ridge * x) / total * 100
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        self.w, self.start, self.move = x[:3 * LEVELS].reshape(3, LEVELS), x[-5], x[-4:].reshape(2, 2)
        return self


def summary(marginals: list[np.ndarray]) -> np.ndarray:
    """Of each document: log odds that any token is tagged, log of the expected tags, and their share."""
    out = np.zeros((len(marginals), 3))
    for i, p in enumerate(marginals):
        if len(p):
            q = np.clip(p, 1e-9, 1 - 1e-9)
            none = np.log1p(-q).sum()
            any_ = -np.expm1(none)
            out[i] = (np.clip(math.log(max(any_, 1e-9)) - none, -12, 12), math.log1p(p.sum()), p.mean())
        else:
            out[i] = (-12, 0, 0)
    return out


class Detector:
    """Evidence, field and calibration; ``prior`` scores everything where labels of both kinds are missing."""

    def __init__(self, prior: float):
        self.words: dict[str, int] = {}
        self.field, self.scale, self.prior = None, np.zeros(4), prior

    def levels(self, words: list[str], cache: Levels) -> np.ndarray:
        return np.fromiter(map(cache.__getitem__, words), np.int8, len(words))

    def tag(self, levels: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(levels)
        lengths = np.array([len(x) for x in levels], np.int64)
        for block in blocks(lengths):
            if not lengths[block[0]]:
                continue
            lev, active = padded(levels, block)
            p = self.field.marginals(lev, active)
            for j, i in enumerate(block):
                out[i] = p[:lengths[i], j]
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.column_stack([features, np.ones(len(features))])
        return 1 / (1 + np.exp(-np.clip(x @ self.scale, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - pen * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(sample: pd.DataFrame, weight_other: float = 1.0) -> Detector:
    """A detector from (text, toxic): evidence from all, the field from a third and the calibration from the rest.

    In both, a document's levels leave its own words out of the evidence.
    """
    toxic = sample["toxic"].to_numpy(np.int64)
    n_yes, n_no = int(toxic.sum()), int(len(toxic) - toxic.sum())
    found = Detector(float(n_yes / (n_yes + weight_other * n_no + 1)))
    if min(n_yes, n_no) < 3:
        return found
    part = np.zeros(len(sample), np.int64)
    for t in (0, 1):
        own = np.flatnonzero(toxic == t)
        part[own] = np.arange(len(own)) % 3
    words = [_WORD.findall(t or "") for t in sample["text"]]
    counts = frequencies([normal(w) for w in words], toxic)
    found.words = evidence(counts, n_yes, n_no)
    without = {1: Levels(evidence(counts, n_yes, n_no, (1, 0))), 0: Levels(evidence(counts, n_yes, n_no, (0, 1)))}
    del counts
    levels = lambda rows: [found.levels(words[i], without[int(toxic[i])]) for i in rows]
    b, c = np.flatnonzero(part == 0), np.flatnonzero(part > 0)
    tagged = bisect.bisect_right(EDGES, TAG) + 1
    lev = levels(b)
    found.field = Field().fit(lev, [((x >= tagged) & bool(toxic[i])).astype(np.int8) for x, i in zip(lev, b, strict=True)])
    x = summary(found.tag(levels(c)))
    found.scale = logistic(np.column_stack([x, np.ones(len(c))]), toxic[c].astype(float), np.where(toxic[c] == 1, 1.0, weight_other))
    return found


def draw(docs: DataFrame, labels: DataFrame, key: str, text: str) -> tuple[pd.DataFrame, float]:
    """At most about MAX_TOXIC and MAX_OTHER labelled texts, by a hash of the key, and the weight of the others."""
    one = labels.where("toxic in (0, 1)").groupBy("key").agg(F.max("toxic").cast("int").alias("toxic"))
    have = docs.select(F.col(key).alias("key")).join(one, "key").groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in have}
    rate = {t: min(1.0, most / max(1, n.get(t, 0))) for t, most in ((1, MAX_TOXIC), (0, MAX_OTHER))}
    u = F.pmod(F.xxhash64("key", F.lit("toxicity")), F.lit(1_000_000)) / 1e6
    picked = one.where(u < F.when(F.col("toxic") == 1, rate[1]).otherwise(rate[0]))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")
    return rows.select(F.xxhash64("key").alias("u"), "text", "toxic").toPandas().sort_values("u", ignore_index=True), 1 / rate[0]


def score_toxicity(docs: DataFrame, training: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Key, score, predicted (score >= threshold) and offending spans of every document.

    Learns from the rows of ``training`` with a label (key, toxic) in ``labels``; a key with
    labels that disagree counts as toxic. ``spans`` has start:end in code points of words
    tagged with a probability over one half, comma-joined. Null and empty texts have no
    words and get the score of a text without evidence; repeated rows are scored alike.
    Without labels of both kinds every score is the toxic share of the labels.
    """
    sample, weight = draw(training, labels, key, text)
    model = docs.sparkSession.sparkContext.broadcast(fit(sample, weight))
    kind = dict(docs.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = model.value
        cache = Levels(found.words)
        for pdf in parts:
            for at in range(0, len(pdf), 5000):
                part = pdf.iloc[at:at + 5000]
                texts = [t or "" for t in part["text"]]
                if found.field is None:
                    yield pd.DataFrame({"key": part["key"], "score": found.prior, "spans": ""})
                    continue
                p = found.tag([found.levels(_WORD.findall(t), cache) for t in texts])
                spans = []
                for t, own in zip(texts, p, strict=True):
                    hit = set(np.flatnonzero(own > 0.5).tolist())
                    spans.append(",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(_WORD.finditer(t)) if i in hit) if hit else "")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "score": found.score(summary(p)), "spans": spans})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = rows.mapInPandas(run, "key string, score double, spans string")
    return out.select(F.col("key").cast(kind).alias(key), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")
