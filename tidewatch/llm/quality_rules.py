"""Quality rules whose thresholds limit the false rejection of good documents.

Each rule rejects a document whose feature is at or beyond a cutoff. Labelled
holdouts give, for each stratum and rule, the number of good documents a cutoff
rejects; an exact binomial test certifies a cutoff if its true rejection rate is
below the rule's share of ``max_false_rejection``. Cutoffs are fixed in advance and
tested from the most lenient on, up to the first that fails, so a rule needs no
correction for its number of cutoffs; strata and rules share ``delta`` evenly
(Bonferroni). With probability 1 - delta all strata's false rejections are limited.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidewatch.llm.common import SPACES, WORD, quoted, written

SYMBOLS = "#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_WORD = re.compile(WORD)
#: Rules: name, feature, and cutoffs from the most lenient on. All reject high values.
RULES = (
    ("symbols", "100.0 * n_symbols / word_chars", (60.0, 45.0, 30.0, 22.0, 16.0, 12.0, 9.0, 7.0, 5.0, 4.0, 3.0, 2.0)),
    ("repeats", "100.0 * n_repeat_words / n_words", (90.0, 75.0, 60.0, 50.0, 40.0, 30.0, 25.0, 20.0, 17.0, 14.0, 12.0, 10.0)),
    ("lines", "100.0 * n_dup_lines / n_words", (50.0, 30.0, 20.0, 15.0, 10.0, 8.0, 6.0, 5.0, 4.0, 3.0, 2.0, 1.0)),
    ("long_words", "1.0 * word_chars / n_words", (60.0, 40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0, 9.0)),
)


def repeat_words(words: list[str], window: int = 5) -> int:
    """Words in windows that occur twice or more, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) > len(words) - 2:  # at most one word repeats once; no two windows can be equal
        return 0
    codes, size = ids, len(number)
    for k in range(1, window):
        _, codes = np.unique(codes[: len(words) - k] * size + ids[k:], return_inverse=True)
    seen = np.bincount(codes)
    hit = seen[codes] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += hit
    edge[window:window + n] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum())


def text_stats(text: str) -> tuple[int, int, int, int, int]:
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def with_stats(docs: DataFrame, text: str, out: str) -> DataFrame:
    """Add a struct with the five counts."""
    @pandas_udf(", ".join(f"{c} long" for c in STATS))
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([text_stats(t or "") for t in texts], columns=list(STATS), dtype="int64")
    # declared nondeterministic so that a filter on the counts does not run it once more
    return docs.withColumn(out, of.asNondeterministic()(F.col(text)))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def feature(rule: tuple, s: Column) -> Column:
    """The rule's feature; 0 for a document without words."""
    top, bottom = rule[1].split(" / ")
    factor, name = top.split(" * ")
    return F.when(s["n_words"] > 0, float(factor) * s[name] / s[bottom]).otherwise(0.0)


def tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial, exactly (in logarithms)."""
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(levels: np.ndarray, quality: np.ndarray, counts: np.ndarray, steps: int, alpha: float, delta: float) -> int:
    """Cutoffs to use: the step (0: none) with the best gain among those certified.

    ``levels``: how many cutoffs a document passes; gain: bad documents rejected
    less good ones.
    """
    good = int(counts[quality == 1].sum())
    best, best_gain = 0, 0
    for step in range(1, steps + 1):
        hit = levels > steps - step  # a lenient cutoff is passed only along with all stricter ones
        k = int(counts[hit & (quality == 1)].sum())
        if tail(k, good, alpha) > delta:
            break
        gain = int(counts[hit & (quality == 0)].sum()) - k
        if gain > best_gain:
            best, best_gain = step, gain
    return best


def thresholds(stats: DataFrame, labels: DataFrame, max_false_rejection: float = 0.04, delta: float = 0.05) -> DataFrame:
    """(stratum, steps): for each rule, how many of its cutoffs are in force.

    ``stats`` has key, stratum, the struct s and the text's digest; ``labels`` has key and quality.
    Copies of a text are no independent draws: each distinct text of a stratum is one
    holdout, and none where its labels disagree.
    Documents that the base rules reject are no holdouts: the method judges the rest.
    Keys with labels that disagree, or without one, are left out.
    """
    one = (labels.where("quality in (0, 1)").groupBy("key").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q"))
           .where("quality = _q").drop("_q"))
    s = F.col("s")
    passed = lambda r: sum((feature(r, s) >= c).cast("int") for c in r[2])
    held = stats.where(~base_failed(s)).select("key", "stratum", "digest", F.array(*[passed(r) for r in RULES]).alias("passed")).join(one, "key")
    held = (held.groupBy("stratum", "digest").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q"), F.first("passed").alias("passed"))
            .where("quality = _q").drop("_q"))
    cells = (held.select("stratum", "quality", F.posexplode("passed").alias("rule", "level"))
             .groupBy("stratum", "quality", "rule", "level").agg(F.count("*").alias("n")))
    strata = max(1, held.select("stratum").distinct().count())
    alpha, each = max_false_rejection / len(RULES), delta / (strata * len(RULES))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = []
        for i, rule in enumerate(RULES):
            own = pdf[pdf["rule"] == i]
            steps.append(certified(own["level"].to_numpy(), own["quality"].to_numpy(), own["n"].to_numpy(), len(rule[2]), alpha, each))
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "steps": [steps]})

    return cells.groupBy("stratum").applyInPandas(choose, "stratum string, steps array<int>")


def verdict(s: Column, steps: Column) -> Column:
    """Kept: the base rules pass, and no rule's cutoff in force is reached."""
    hits = []
    for i, r in enumerate(RULES):
        step = F.coalesce(F.get(steps, F.lit(i)), F.lit(0))
        cut = F.get(F.array(*[F.lit(c) for c in r[2]]), step - 1)
        hits.append(F.coalesce((step > 0) & (feature(r, s) >= cut), F.lit(False)))
    return ~base_failed(s) & ~F.greatest(*hits)


def digest(text: Column) -> Column:
    """Tells texts apart: 128 bits."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _stratum(col: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("null"))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
          max_false_rejection: float = 0.04, delta: float = 0.05) -> DataFrame:
    """Counts and verdict of every document: key, the five counts, base_failed, kept.

    A null text has no words and fails the base rules; a null stratum is a stratum.
    Strata without enough labelled holdouts get no cutoffs: only base rules reject
    there. Repeated rows are judged alike. An empty table gives an empty result.
    """
    rows = with_stats(docs.select(F.col(key).alias("key"), _stratum(F.col(stratum)).alias("stratum"), F.col(text).alias("_text")), "_text", "s")
    rows = rows.withColumn("digest", digest(F.col("_text"))).drop("_text")
    rows = written(rows, "quality-stats")
    cuts = written(thresholds(rows, labels, max_false_rejection, delta), "quality-cuts")
    s = F.col("s")
    return rows.join(cuts, "stratum", "left").select(
        F.col("key").alias(key), *[s[c].alias(c) for c in STATS], base_failed(s).alias("base_failed"), verdict(s, F.col("steps")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang",
              max_false_rejection: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The documents that ``judge`` keeps, all columns as they are, whatever their names.

    The counts are written once, beside the documents.
    """
    own = F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("own")
    rows = docs.select(own).select("own", F.col("own")[key].alias("key"), _stratum(F.col("own")[stratum]).alias("stratum"), F.col("own")[text].alias("text"))
    rows = written(with_stats(rows, "text", "s").withColumn("digest", digest(F.col("text"))).drop("text"), "quality-documents")
    cuts = written(thresholds(rows.drop("own"), labels, max_false_rejection, delta), "quality-cuts")
    return rows.join(cuts, "stratum", "left").where(verdict(F.col("s"), F.col("steps"))).select("own.*")
