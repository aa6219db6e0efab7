"""URL filter: rules first, then a ratio of two character models (native expressions).

URLs that a rule allows or blocks teach two smoothed variable-order Markov models.
Every other URL is judged by the difference of its mean log-likelihoods, against a
threshold calibrated on labelled URLs that neither model has seen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import LOWER, UPPER, written

#: host, path, verdict; a rule fits its host and all subdomains.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Printable ASCII, one sign for everything else, a start and an end sign: trigrams number
#: at most 98 ** 3 = 941,192 whatever the input, so the model may be broadcast.
OTHER, START, END = "\x7f", "\x02", "\x03"
SYMBOLS = 98
#: Strength of the shorter context's estimate, in observations.
SHORTER = 4.0
#: Steps of the calibrated threshold, per unit of mean log10 ratio.
STEPS = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        this = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, this) if out is None else out.when(fits, this)
    return out


def trigrams(text: Column) -> Column:
    """The trigrams of a folded URL, one for each character and one for the end."""
    folded = F.regexp_replace(text, r"[^\x20-\x7E]", OTHER)
    padded = F.concat(F.lit(START * 2), folded, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, 3))


def ratio_model(grams: DataFrame) -> DataFrame:
    """log10 p(character | context) under the accepted less under the rejected model, for each trigram.

    ``grams`` has gram, acc, rej: counts of training occurrences; trigrams seen
    only elsewhere have zeros. Estimates mix the counts after two characters with
    those after one and none; an unseen context leaves all weight to the shorter.
    """
    def sums(name: str, key: Column) -> DataFrame:
        return grams.groupBy(key.alias(name)).agg(F.sum("acc").alias(f"{name}_acc"), F.sum("rej").alias(f"{name}_rej"))

    g = F.col("gram")
    parts = {"c2": F.substring(g, 1, 2), "b2": F.substring(g, 2, 2), "c1": F.substring(g, 2, 1), "u": F.substring(g, 3, 1)}
    rows = grams
    for name, key in parts.items():
        rows = rows.withColumn(name, key).join(sums(name, key), name)
    total = grams.agg(F.coalesce(F.sum("acc"), F.lit(0)).alias("acc"), F.coalesce(F.sum("rej"), F.lit(0)).alias("rej")).first()
    rows = rows.withColumn("all_acc", F.lit(total["acc"])).withColumn("all_rej", F.lit(total["rej"]))

    def log_p(side: str) -> Column:
        n = lambda name: F.col(f"{name}_{side}")
        p1 = (n("u") + 1) / (n("all") + SYMBOLS)
        p2 = (n("b2") + SHORTER * p1) / (n("c1") + SHORTER)
        return F.log10((F.col(side) + SHORTER * p2) / (n("c2") + SHORTER))

    return rows.select("gram", (log_p("acc") - log_p("rej")).alias("ratio"))


def calibrated(scores: DataFrame) -> DataFrame:
    """One row: the threshold (in steps) with the least mean error rate of both labels.

    ``scores`` has bin (long) and verdict of labelled URLs held out from training.
    Accept from the threshold up. Among the best the one nearest to 0 is taken, then
    the smaller; where a label is missing it is 0. The bins are bounded by the range
    of a log ratio, so the window is small whatever the input.
    """
    bins = scores.groupBy("bin").agg(F.sum((F.col("verdict") == "allow").cast("long")).alias("a"),
                                     F.sum((F.col("verdict") == "block").cast("long")).alias("r"))
    cuts = bins.select("bin").union(bins.select(F.col("bin") + 1)).union(bins.select(F.lit(0).cast("long"))).distinct()
    steps = cuts.join(bins, "bin", "left").fillna(0, ["a", "r"])
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    steps = (steps.withColumn("miss", F.coalesce(F.sum("a").over(below), F.lit(0)))
             .withColumn("blocked", F.coalesce(F.sum("r").over(below), F.lit(0)))
             .withColumn("na", F.sum("a").over(whole)).withColumn("nr", F.sum("r").over(whole)))
    error = F.when((F.col("na") > 0) & (F.col("nr") > 0),
                   F.col("miss") / F.col("na") + (F.col("nr") - F.col("blocked")) / F.col("nr")).otherwise(0.0)
    best = F.min(F.struct(F.round(error, 9).alias("e"), F.abs("bin").alias("d"), F.col("bin").alias("cut")))
    return steps.agg(best.alias("b")).select(F.coalesce(F.col("b.cut"), F.lit(0)).alias("cut"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id",
                url: str = "url") -> DataFrame:
    """Judge every URL: key, host, path, rule, verdict and score (mean log10 ratio).

    Four of five labelled URLs (by hash) train the models, the fifth calibrates.
    A null URL, or one without ``://``, has an empty host and path and fits no rule;
    null and empty URLs are scored by their end sign. Equal URLs get equal verdicts.
    Without labelled URLs all ratios are 0 and the method allows. Other columns are
    not read; an empty table gives an empty result.
    """
    host, path = host_and_path(F.col("_url"))
    rows = pages.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"),
                        F.coalesce(F.col(url), F.lit("")).alias("_url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("_url"), F.lit(5)))
    chars = rows.select("_row", "_key", "host", "path", "_rule", "_fold", F.explode(trigrams(F.col("_url"))).alias("gram"))
    learn = F.col("_fold") != 0
    grams = chars.groupBy("gram").agg(
        F.sum(F.coalesce(learn & (F.col("_rule.verdict") == "allow"), F.lit(False)).cast("long")).alias("acc"),
        F.sum(F.coalesce(learn & (F.col("_rule.verdict") == "block"), F.lit(False)).cast("long")).alias("rej"))
    model = ratio_model(written(grams, "url-grams"))
    scored = (chars.join(F.broadcast(model), "gram")
              .groupBy("_row").agg(F.first("_key").alias("_key"), F.first("host").alias("host"), F.first("path").alias("path"),
                                   F.first("_rule").alias("_rule"), F.first("_fold").alias("_fold"),
                                   F.floor(F.round(F.avg("ratio") * STEPS, 6)).alias("bin"), F.avg("ratio").alias("score")))
    scored = written(scored, "url-scores")
    cut = calibrated(scored.where((F.col("_fold") == 0) & F.col("_rule").isNotNull())
                     .select("bin", F.col("_rule.verdict").alias("verdict"))).first()["cut"]
    own = F.when(F.col("bin") >= F.lit(cut), "allow").otherwise("block")
    return scored.select(F.col("_key").alias(key), "host", "path", F.col("_rule.rule").alias("rule"),
                         F.coalesce(F.col("_rule.verdict"), own).alias("verdict"), "score")
