"""Mixing sources to target weights by Sainte-Lague apportionment of word blocks (native expressions)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import WORD, identified, quoted, written

#: Words of a data shard: sources are cut into shards of about so many words, at most MAX_SHARDS.
#: The number bounds a window over one source's shards; a shard then grows with its source.
SHARD_WORDS, MAX_SHARDS = 1 << 16, 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_number(*cols: Column) -> Column:
    """48 bits of an md5 as a long: the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("long")


def target_words(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5,
                 cap: float = 2.0) -> DataFrame:
    """Targets of the sources, from (source, source_size).

    Sources take the weights in the order of their code points, null last,
    repeating. They share ``share`` of all words by weight; a target stops at
    ``cap`` times its source's size and the excess is shared anew. Sorted by
    cap / weight, the sources that reach their cap are a prefix, so two running
    sums settle it. One row per source goes through these windows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("_fill", F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    rows = (sizes.withColumn("_w", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1)))
            .withColumn("_cap", F.col("source_size") * cap)
            .withColumn("_fill", F.col("_cap") / F.col("_w"))
            .withColumn("_all", F.sum("source_size").over(Window.partitionBy()) * share))
    before = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_all") - before) / left)
    rows = rows.withColumn("_open", F.when(F.col("_fill") > F.col("_level"), F.col("_level")))
    rows = rows.withColumn("_level", F.max("_open").over(Window.partitionBy()))
    target = F.when(F.col("_open").isNotNull(), F.col("_w") * F.col("_level")).otherwise(F.col("_cap"))
    return rows.select("source", "source_size", target.alias("target"))


def sainte_lague(votes: DataFrame, groups: list[str], vote: str, seats: str, tie: list[str],
                 out: str) -> DataFrame:
    """Seats of each row by highest quotients vote / 1, vote / 3, vote / 5, ... within each group.

    ``seats`` is the group's number of seats. With n rows, any divisor that seats
    everybody gives a row its exact share q of the seats, more or less
    n / 2 * (its part of the votes) + 1 / 2; only quotients inside this range are
    ranked, some 3 n in all, and seats below it are certain. Ties go to the
    smaller ``tie`` columns. Rows without votes get no seats.
    """
    part = Window.partitionBy(*groups)
    rows = (votes.withColumn("_v", F.sum(vote).over(part).cast("double"))
            .withColumn("_rows", F.count("*").over(part))
            .withColumn("_part", F.when(F.col("_v") > 0, F.col(vote) / F.col("_v")).otherwise(0.0))
            .withColumn("_q", F.col("_part") * F.col(seats))
            .withColumn("_around", F.col("_rows") / 2 * F.col("_part") + 0.5)
            .withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col("_q") - F.col("_around") - 1e-6)).cast("long"))
            .withColumn("_hi", F.greatest(F.col("_lo") + 1, F.ceil(F.col("_q") + F.col("_around") + 1e-6)).cast("long"))
            .withColumn("_rest", F.col(seats) - F.sum("_lo").over(part)))
    keep = votes.columns
    ranked = rows.withColumn("_k", F.explode(F.sequence(F.col("_lo") + 1, F.col("_hi"))))
    rank = Window.partitionBy(*groups).orderBy((F.col(vote) / (2 * F.col("_k") - 1)).desc(), *[F.col(t).asc_nulls_last() for t in tie], "_k")
    won = (F.row_number().over(rank) <= F.col("_rest")) & (F.col(vote) > 0)
    return (ranked.withColumn("_won", won.cast("long"))
            .groupBy(*keep, "_lo").agg(F.sum("_won").alias("_more"))
            .select(*keep, (F.col("_lo") + F.col("_more")).alias(out)))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                block: int = 64, seed: str = "mix", key: str = "doc_id", text: str = "text",
                source: str = "source", row: str | None = None) -> DataFrame:
    """How many words the mix takes from every document.

    Each source's target is met in blocks of ``block`` words: Sainte-Lague gives
    sources their blocks, and then each source's shards theirs. A shard is a
    stream of its documents in seeded order; its blocks are whole rounds through
    the stream and then a run of blocks from a seeded place, around the end if
    need be. So few documents are cut, and none is taken over ``cap`` (2) times.

    Returns key, source, size (words), source_size, target, taken, whole (times
    the whole text is taken) and two word ranges [from1, to1), [from2, to2) taken
    once more (empty where the ends are equal), plus row: the column ``row``, or a number
    of its own. Texts of one key go to shards of their own, so a frequent key spreads. A null text has no words; a null source is a source, the last; repeated rows
    are documents of their own. Where nothing has words, targets and takings are 0.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(key).alias("_key"),
                       F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
                       hash_number(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("_h"),
                       hash_number(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("string")).alias("_spread"))
    rows = written(rows, "mix-sizes")
    goal = target_words(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    goal = goal.withColumn("_seats_all", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    goal = sainte_lague(goal, [], "target", "_seats_all", ["source"], "_seats").drop("_seats_all")
    goal = goal.withColumn("_shards", F.least(F.lit(MAX_SHARDS), F.floor(F.col("source_size") / SHARD_WORDS) + 1))
    goal = goal.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    goal = written(goal, "mix-goal")
    rows = rows.withColumn("_name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    rows = rows.join(F.broadcast(goal.select("_name", "_shards", "source_size", "target", "_seats"))
                     if goal.count() <= 10_000 else goal.select("_name", "_shards", "source_size", "target", "_seats"), "_name")
    rows = rows.withColumn("_shard", F.col("_spread") % F.col("_shards"))
    shards = rows.groupBy("_name", "_shard", "_seats").agg(F.sum("size").alias("_words"))
    shards = sainte_lague(shards, ["_name"], "_words", "_seats", ["_shard"], "_blocks").drop("_seats")
    shards = (shards.withColumn("_quota", F.least(F.col("_blocks") * block, F.floor(F.col("_words") * cap)))
              .withColumn("_rounds", F.when(F.col("_words") > 0, F.floor(F.col("_quota") / F.col("_words"))).otherwise(0))
              .withColumn("_rest", F.col("_quota") - F.col("_rounds") * F.col("_words"))
              .withColumn("_o", F.when(F.col("_words") > 0, hash_number(F.lit(seed), F.col("_name"), F.col("_shard").cast("string"))
                          % F.ceil(F.col("_words") / block) * block).otherwise(0))
              .select("_name", "_shard", "_words", "_rounds", "_rest", "_o"))
    stream = Window.partitionBy("_name", "_shard").orderBy("_h", "_key", "row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_a", F.sum("size").over(stream) - F.col("size")).join(shards, ["_name", "_shard"])
    a, e = F.col("_a"), F.col("_a") + F.col("size")
    end = F.col("_o") + F.col("_rest")
    rows = (rows.withColumn("from1", F.least(F.greatest(a, F.col("_o")), e) - a)
            .withColumn("to1", F.greatest(F.least(e, end) - a, F.col("from1")))
            .withColumn("from2", F.lit(0).cast("long"))
            .withColumn("to2", F.greatest(F.lit(0), F.least(e, end - F.col("_words")) - a)))
    return rows.select("row", F.col("_key").alias(key), "source", "size", "source_size", "target",
                       (F.col("_rounds") * F.col("size") + F.col("to1") - F.col("from1") + F.col("to2")).cast("long").alias("taken"),
                       F.col("_rounds").cast("long").alias("whole"), *[F.col(c).cast("long").alias(c) for c in ("from1", "to1", "from2", "to2")])


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: a row for each whole taking of a document and one for each cut range, all columns kept.

    A cut text runs from its first taken word to its last, white space between them
    included. Documents that the mix does not take go; those without words are never
    taken by words and stay once.
    """
    docs = identified(docs, "mix-documents")
    own = F.col("own")
    narrow = docs.select("row", own[key].alias("key"), own[text].alias("text"), own[source].alias("source"))
    taken = mix_sources(narrow, key="key", text="text", source="source", row="row", **options)
    plan = taken.where("taken > 0 or size = 0").select(
        "row",
        F.concat(
            F.when(F.col("whole") + (F.col("size") == 0).cast("long") > 0,
                   F.array_repeat(F.struct(F.lit(0).cast("long").alias("a"), F.col("size").alias("b")),
                                  F.greatest(F.col("whole"), (F.col("size") == 0).cast("long")).cast("int")))
            .otherwise(F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")),
            F.filter(F.array(F.struct(F.col("from1").alias("a"), F.col("to1").alias("b")), F.struct(F.col("from2").alias("a"), F.col("to2").alias("b"))),
                     lambda r: r["a"] < r["b"])).alias("ranges"), "size")
    plan = written(plan, "mix-plan")
    rows = docs.join(plan, "row").withColumn("range", F.explode("ranges"))
    a, b = F.col("range.a"), F.col("range.b")
    whole = (a == 0) & (b == F.col("size"))
    # before word a: a words, each with the white space after it; what is left has b - a words and perhaps more
    words = F.regexp_extract_all(own[text], F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    part = F.regexp_replace(F.array_join(F.slice(words, (a + 1).cast("int"), (b - a).cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    return rows.select(own.withField(quoted(text), F.when(whole, own[text]).otherwise(part)).alias("own")).select("own.*")
