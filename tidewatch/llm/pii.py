"""Personal data: pattern spans, and identifiers found by bootstrapped lexical contexts (native expressions).

Seed entities come from fixed patterns. The one and the two words before them become
lexical patterns; a bipartite graph of patterns and instances is scored in rounds, and
patterns of high confidence mark further identifiers, of any shape and of several words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, identified, quoted, written

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns, with possessive repeats where giving back never helps and, for emails,
#: no start inside a run that has failed: the same matches, found in linear time.
_LOCAL = r"A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a lexical pattern may mark: words with a digit or an at sign, one after the other on a line, up to punctuation.
_WORD = r"(?=[^\x20\x09-\x0D]*[0-9@])[^\x20\x09-\x0D]++"
CANDIDATE = rf"(?<![^\x20\x09-\x0D]){_WORD}(?:(?<![,;:.!?])[\x20\x09]++{_WORD})*+"
#: The word, and the word before that, which end a text but for white space and opening marks.
LEFT = r"(?:([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++)?(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)[\x20\x09-\x0D]++[(\[{<\"']*+$"
_LAST = r"^[(\[{<\"']*+[\x20\x09-\x0D]++[^\x20\x09-\x0D]++(?:[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)?+"
TRIM = r"^[(\[{<\"']+|[)\]}>\"'.,;:!?]+$"


def valid(kind: Column, match: Column) -> Column:
    """What a match must pass beyond its pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.length(digits)
    luhn = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda acc, i: acc + F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]),
                                          F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") + 1) * (i % 2 == 0).cast("int")
        + F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * (i % 2 == 1).cast("int")) % 10 == 0
    parts = F.split(match, r"\.")
    bare = lambda p: F.regexp_replace(p, "^0+", "")
    small = F.forall(parts, lambda p: (F.length(bare(p)) <= 3) & (F.substring(F.concat(F.lit("000"), bare(p)), -3, 3).cast("int") <= 255))
    return (F.when(kind == 0, True).when(kind == 1, small)
            .when(kind == 2, F.when(n.between(16, 19), luhn).otherwise(False))
            .when(kind == 3, n.between(8, 15)).otherwise(False))


def pieces(text: Column, kind: int, pattern: str) -> Column:
    """Array of (kind, gap before, match, end of the gap) for all matches of a pattern, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.when(F.size(found) > 0, F.zip_with(
        F.slice(gaps, 1, F.size(found)), found,
        lambda g, m: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), m.alias("match"), last_words(g).alias("left"))))


def last_words(gap: Column) -> Column:
    """What contexts() looks at: the last two words of a gap, whole, with what follows them."""
    return F.reverse(F.regexp_extract(F.reverse(gap), _LAST, 0))


def contexts(left: Column) -> Column:
    """Lexical patterns of a text that ends before an identifier: its last word, and its last two."""
    left = ascii_lower(left)
    one, two = F.regexp_extract(left, LEFT, 2), F.regexp_extract(left, LEFT, 1)
    return F.filter(F.array(one, F.when((one != "") & (two != ""), F.concat_ws(" ", two, one))), lambda p: p.isNotNull() & (p != ""))


def shape(match: Column) -> Column:
    """Digits as 9, letters as a, runs as one."""
    return F.regexp_replace(F.regexp_replace(match, r"\p{L}+", "a"), "[0-9]+", "9")


def seed_spans(rows: DataFrame) -> DataFrame:
    """(row, key, kind, start, end, match, left) from (row, key, text); kind -1 once for each row, 4 for candidates."""
    text = F.col("text")
    digit = F.regexp_instr(text, F.lit("[0-9]")) > 0
    at = F.instr(text, "@") > 0
    empty = F.expr("cast(array() as array<struct<kind:int,gap:int,match:string,left:string>>)")
    one = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("match"), F.lit(None).cast("string").alias("left")))
    some = [F.coalesce(F.when(at if k == "email" else digit, pieces(text, i, PATTERNS[k])), empty) for i, k in enumerate(KINDS)]
    some.append(F.coalesce(F.when(digit | at, pieces(text, 4, CANDIDATE)), empty))
    found = rows.select("row", "key", F.posexplode(F.concat(one, *some)).alias("pos", "m")).select("row", "key", "pos", "m.*")
    found = written(found, "pii-matches")
    run = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(run)
    return (found.withColumn("end", end.cast("long"))
            .withColumn("start", F.col("end") - F.coalesce(F.length("match"), F.lit(0)))
            .where((F.col("kind").isin(-1, 4)) | valid(F.col("kind"), F.col("match"))))


def open_candidates(spans: DataFrame) -> DataFrame:
    """(row, start, instance, left) of the candidates that begin outside base spans, each up to the next base span."""
    base = F.col("kind") < 4
    order = Window.partitionBy("row").orderBy("start", "kind")
    taken = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first(F.when(base, F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    # leading marks are no part of an identifier, and a base span may begin right after them
    lead = F.when(base, F.lit(0)).otherwise(F.length(F.regexp_extract("match", r"^[(\[{<\"']+", 0)))
    rows = (spans.where("kind >= 0").withColumn("start", F.col("start") + lead).withColumn("match", F.expr("substring(match, cast(end - start as int) * -1)"))
            .withColumn("_taken", taken).withColumn("_next", following))
    return (rows.where(~base & (F.coalesce("_taken", F.lit(0)) <= F.col("start")))
            .withColumn("instance", F.col("match").substr(F.lit(1), (F.least("end", F.coalesce("_next", "end")) - F.col("start")).cast("int")))
            .withColumn("instance", F.regexp_replace("instance", r"[\x20\x09-\x0D]+$", ""))
            .withColumn("instance", F.regexp_replace("instance", TRIM, "")).where("instance <> ''")
            .select("row", "start", "instance", "left"))


def bootstrap(spans: DataFrame, rounds: int = 3, min_score: float = 0.8, min_instances: int = 8, shape_weight: float = 0.1) -> DataFrame:
    """Spans of unseen identifiers: (row, kind, start, end).

    A candidate is a run of identifier-like words outside base spans; its patterns are
    the word before it and the two words before it. Seeds are the whole valid base
    spans. Edges of the graph are distinct (pattern, instance) pairs, so copies of a text
    count once. In each round a pattern's score for a kind is the mean score of its
    instances, lowered for few of them (a pattern needs ``min_instances`` distinct seed
    instances and at least ``min_score``), and an instance that is no seed takes the
    best score of its passing patterns. Seeds keep score 1 for their kind, 0 for others.
    The shape is a weak feature: a score loses ``shape_weight`` of itself where no seed of
    the pattern has the instance's shape, and a span needs ``min_score`` less half that part.
    """
    base = (spans.where(F.col("kind").between(0, 3))
            .select("row", "start", F.col("match").alias("instance"), "left", F.col("kind").alias("seed")))
    words = base.unionByName(open_candidates(spans), allowMissingColumns=True)
    words = words.withColumn("pattern", F.explode(contexts(F.col("left")))).select("row", "start", "instance", "pattern", "seed")
    words = written(words, "pii-words")
    edges = written(words.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    strong = edges.where("seed is not null").groupBy("pattern", "seed").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= min_instances)
    strong = strong.select("pattern", F.col("seed").alias("kind"))
    graph = edges.join(strong, "pattern").withColumn("shape", shape(F.col("instance")))
    shapes = graph.where("seed = kind").select("pattern", "kind", "shape").distinct().withColumn("like", F.lit(1.0))
    graph = written(graph.join(shapes, ["pattern", "kind", "shape"], "left").withColumn("like", F.coalesce("like", F.lit(1.0 - shape_weight))).drop("shape"), "pii-graph")
    score = graph.where("seed is null").select("instance", "kind").distinct().withColumn("score", F.lit(0.0))
    passing = None
    for _ in range(rounds):
        of = graph.join(score, ["instance", "kind"], "left")
        value = F.when(F.col("seed").isNotNull(), (F.col("seed") == F.col("kind")).cast("double")).otherwise(F.coalesce("score", F.lit(0.0)))
        patterns = of.groupBy("pattern", "kind").agg(F.sum(value).alias("good"), F.count("*").alias("n"))
        passing = written(patterns.withColumn("score", F.col("good") / (F.col("n") + 1.0)).where(F.col("score") >= min_score)
                          .select("pattern", "kind", "score"), "pii-patterns")
        score = (graph.where("seed is null").join(passing, ["pattern", "kind"])
                 .groupBy("instance", "kind").agg(F.max(F.col("score") * F.col("like")).alias("score")))
    marks = (graph.where("seed is null").join(passing, ["pattern", "kind"]).withColumn("score", F.col("score") * F.col("like"))
             .where(F.col("score") >= min_score * (1 - shape_weight / 2)).select("pattern", "instance", "kind", "score"))
    new = words.where("seed is null").join(marks, ["pattern", "instance"])
    best = F.max(F.struct("score", (-F.col("kind")).alias("minus"))).alias("b")
    return (new.groupBy("row", "start", "instance").agg(best)
            .select("row", (-F.col("b.minus")).alias("kind"), "start", (F.col("start") + F.length("instance")).alias("end")))


def pii_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", row: str | None = None) -> DataFrame:
    """(row, key, kind, start, end, base) of all spans, and one row of kind -1 for each document.

    ``row`` is the column of that name, or a number of its own. Found spans never overlap a base span.
    """
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).alias("key"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = seed_spans(rows)
    base = spans.where("kind < 4").select("row", "key", "kind", "start", "end", F.lit(True).alias("base"))
    found = bootstrap(spans)
    taken = spans.where(F.col("kind").between(0, 3)).select("row", F.col("start").alias("s"), F.col("end").alias("e"))
    found = found.join(taken, (found["row"] == taken["row"]) & (found["start"] < taken["e"]) & (taken["s"] < found["end"]), "left_anti")
    return base.unionByName(found.select("row", F.lit(None).cast(dict(base.dtypes)["key"]).alias("key"), "kind", "start", "end", F.lit(False).alias("base")))


def detect_pii(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every document: key, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Counts and base_sha256 are of the base spans; ``spans`` has those and the found
    ones, as kind:start:end in code points, by kind and then start, comma-joined.
    Null and empty texts have no spans; repeated rows are documents of their own; an
    empty table gives an empty result. Other columns are not read.
    """
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = pii_spans(docs, key, text)
    at = F.struct("kind", "start", "end")
    out = spans.groupBy("row").agg(
        F.max("key").alias("_key"),
        *[F.sum(((F.col("kind") == i) & F.col("base")).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when((F.col("kind") >= 0) & F.col("base"), at))).alias("_base"),
        F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, at))).alias("_all"))
    joined = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select(F.col("_key").alias(key), *[f"n_{k}" for k in KINDS],
                      F.sha2(joined("_base").cast("binary"), 256).alias("base_sha256"), joined("_all").alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, all columns kept.

    Where spans of two kinds overlap, the later one keeps what lies beyond the earlier.
    Rows without spans pass unchanged, nulls included; the names of columns don't matter.
    """
    names = F.array(*[F.lit("<" + k.upper() + ">") for k in KINDS])
    docs = identified(docs, "pii-documents")
    own = F.col("own")
    spans = pii_spans(docs.select("row", own[key].alias("key"), own[text].alias("text")), "key", "text", "row").where("kind >= 0")
    run = Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = (spans.withColumn("before", F.coalesce(F.max("end").over(run), F.lit(0)))
           .withColumn("start", F.greatest("start", "before")).where(F.col("start") < F.col("end"))
           .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts")))
    cut = written(cut, "pii-cuts")
    whole = own[text]
    n = F.size("cuts")
    body = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.substring(whole, F.when(i > 1, F.try_element_at("cuts", i - 1)["end"]).otherwise(0).cast("int") + 1,
                    (F.element_at("cuts", i)["start"] - F.when(i > 1, F.try_element_at("cuts", i - 1)["end"]).otherwise(0)).cast("int")),
        F.element_at(names, F.element_at("cuts", i)["kind"] + 1))), "")
    tail = F.substring(whole, F.element_at("cuts", -1)["end"].cast("int") + 1, F.length(whole))
    rows = docs.join(cut, "row", "left")
    return rows.select(own.withField(quoted(text), F.when(F.col("cuts").isNull(), whole).otherwise(F.concat(body, tail))).alias("own")).select("own.*")
