import math
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import brute
from tidewatch.llm import components, lm_scoring, packing, quality_rules, simhash_dedup, topk_search, toxicity

SF = "/root/testdata/sf0.01"


def real(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# -- language model

@pytest.mark.parametrize("source", ["fixture", "table"])
def test_base_scores_exact(spark, docs, source):
    df = docs if source == "fixture" else real(spark)
    train = df.where("doc_id % 3 <> 1")
    c = Counter()
    for r in train.collect():
        c.update(brute.words(r.text, True))
        c["\n"] += 1
    n, v = sum(c.values()), len(c)
    rows = lm_scoring.score_texts(df, train).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    assert len(rows) == df.count()
    for r in rows:
        w = [*brute.words(texts[r.doc_id], True), "\n"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9, abs_tol=1e-7)
        assert r.score <= 0


def test_model_is_close_to_exact_discounting(spark):
    """The filter's probabilities against the same model with exact dictionaries."""
    df = real(spark)
    train = df.where("doc_id % 3 <> 1")
    uni, bi = Counter(), Counter()
    for r in train.collect():
        w = [*brute.words(r.text, True), "\n"]
        uni.update(w)
        bi.update(zip(["\n", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(x == k for x in bi.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    kept = defaultdict(float)
    for (a, _), x in bi.items():
        if x > 1:
            kept[a] += (x - d) / uni[a]

    def log_p(a, b):
        c = bi[a, b] if bi[a, b] > 1 else 0
        return math.log10(max(c - d, 0) / max(1, uni[a]) + (1 - kept[a]) * (uni[b] + 1) / (n + v + 1))

    got = {r.doc_id: r for r in lm_scoring.score_texts(df, train).where("doc_id % 3 = 1").collect()}
    exact = model = base = tokens = 0.0
    for r in df.where("doc_id % 3 = 1").collect():
        w = [*brute.words(r.text, True), "\n"]
        exact += sum(log_p(a, b) for a, b in zip(["\n", *w[:-1]], w, strict=True))
        model, base, tokens = model + got[r.doc_id].score, base + got[r.doc_id].base_score, tokens + len(w)
    assert model > base
    assert abs(model - exact) / tokens < 0.12


def test_filter_reads_what_it_holds():
    rnd = np.random.default_rng(1)
    keys = rnd.integers(0, 2 ** 63, 20000).astype(np.uint64)
    q = rnd.integers(1, 9, 20000)
    f = lm_scoring.Filter(1, int(q.sum()) * lm_scoring.BITS_PER_ENTRY // 8 * 8)
    f.data = np.frombuffer(f.build(keys, q), np.uint8)
    got = f.read(keys)
    assert (got >= q).all() and (got > q).mean() < 0.02
    assert (f.read(rnd.integers(0, 2 ** 63, 20000).astype(np.uint64)) > 0).mean() < 0.02


def test_reading_by_steps_equals_probing_every_level():
    """Keys of all quanta and unknown ones; remembered words read as they did at first."""
    rnd = np.random.default_rng(2)
    keys = rnd.integers(0, 2 ** 63, 30000).astype(np.uint64)
    q = rnd.integers(0, 90, 30000) // 6 * rnd.integers(0, 5, 30000)
    f = lm_scoring.Filter(4, int(q.sum()) * lm_scoring.BITS_PER_ENTRY // 32 * 8)
    chunk = lm_scoring.chunk_of(keys, 4)
    f.data = np.concatenate([np.frombuffer(f.build(keys[chunk == c], q[chunk == c]), np.uint8) for c in range(4)])
    got = f.read(keys)
    every, alive, level = np.zeros(len(keys), int), np.arange(len(keys)), 1
    while len(alive):
        alive = alive[f.holds(*(x[alive] for x in f.probe(keys)), level)]
        every[alive] = level
        level += 1
    assert (got >= q).all() and (got != every).mean() < 0.001 and (got[q == 0] > 0).mean() < 0.01
    known = lm_scoring.Known()
    words = np.unique(keys)
    read = lambda k: np.stack([f.read(k), f.read(k)])
    for part in (words[::3], words[1::2], words):
        assert (known(part, read)[0] == f.read(part)).all()


def test_quanta_understate_by_a_fifth_at_most_and_false_hits_are_rare():
    counts = np.arange(1, 20000)
    assert (lm_scoring.value(lm_scoring.quantised(counts, 1), 1) >= 0.8 * counts - 1e-6).all()
    rnd = np.random.default_rng(2)
    f = lm_scoring.Filter(1, 200_000 * lm_scoring.BITS_PER_ENTRY)
    f.data = np.frombuffer(f.build(rnd.integers(0, 2 ** 63, 200_000).astype(np.uint64), np.ones(200_000, int)), np.uint8)
    assert (f.read(rnd.integers(0, 2 ** 63, 200_000).astype(np.uint64)) > 0).mean() < 0.0045


def test_least_count_keeps_to_the_bound_and_small_filters_work(spark):
    df = real(spark)
    model, _ = lm_scoring.train(df.select("text"), 64 << 10)
    assert sum(len(f.data) for f in (model.words, model.pairs, model.weights)) <= 70 << 10
    assert model.least[2] > 2
    rows = lm_scoring.score_texts(df, df, max_bytes=64 << 10).agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s < 0 and rows.s > 1.2 * rows.b


def few_words(spark):
    """200 texts of 300 of 300 words: the pairs are many more than the words."""
    rnd = np.random.default_rng(17)
    return spark.createDataFrame([(i, " ".join(f"w{x}" for x in rnd.integers(0, 300, 300))) for i in range(200)], "doc_id long, text string")


@pytest.mark.parametrize("max_bytes,table,rest", [
    (lm_scoring.MAX_FILTER_BYTES, real, set()), (64 << 10, real, {1, 2, 3}), (64 << 10, few_words, {2})])
def test_model_is_whole_whatever_the_filters_hold(spark, max_bytes, table, rest):
    """All pairs, rare ones too, against exact dictionaries; small filters leave the rest, or pairs alone, to the tables."""
    df = table(spark)
    train, held = df.where("doc_id % 3 <> 1"), df.where("doc_id % 3 = 1")
    uni, bi = Counter(), Counter()
    for r in train.collect():
        w = [*brute.words(r.text, True), "\n"]
        uni.update(w)
        bi.update(zip(["\n", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    once, twice = (sum(x == k for x in bi.values()) for k in (1, 2))
    d = once / (once + 2 * twice)
    # as the model reads them: lower edges of quanta from the least count of the filters, or from 1
    model, _, pairs, _ = lm_scoring.trained(train.select("text"), max_bytes, 1)
    assert model.rest == rest
    assert pairs.count() == sum(x < model.least[2] for x in bi.values())
    start = lambda x, kind: model.least[kind] if x >= model.least[kind] else 1
    quantum = lambda x, kind: int(lm_scoring.quantised(np.array(x), start(x, kind)))
    low = lambda x, kind: start(x, kind) * lm_scoring.LOG_BASE ** (quantum(x, kind) - 1)
    share = {a: 1 / (start(x, 1) * lm_scoring.LOG_BASE ** quantum(x, 1)) for a, x in uni.items()}
    kept = defaultdict(float)
    for (a, _), x in bi.items():
        kept[a] += max(low(x, 2) - d, 0) * share[a]

    def log_p(a, b):
        seen = max(low(bi[a, b], 2) - d, 0) * share[a] if (a, b) in bi else 0
        gamma = lm_scoring.WEIGHT_BASE ** -math.ceil(-math.log(max(1e-5, 1 - kept[a])) / math.log(lm_scoring.WEIGHT_BASE) - 1e-9)
        return math.log10(min(1, seen + gamma * ((low(uni[b], 1) if b in uni else 0) + 1) / (n + v + 1)))

    got = {r.doc_id: r.score for r in lm_scoring.score_texts(held, train, max_bytes=max_bytes, rarest_pair=1).collect()}
    off = []
    for r in held.collect():
        w = [*brute.words(r.text, True), "\n"]
        off.append(abs(got[r.doc_id] - sum(log_p(a, b) for a, b in zip(["\n", *w[:-1]], w, strict=True))) / len(w))
    assert len(off) == len(got) and np.mean(off) < 0.02 and max(off) < 0.6


def test_open_pairs_and_rare_words_are_asked_in_packed_rows(spark, monkeypatch):
    """op1: no row for each document and open pair is written, and base and score are those of a model whose filters hold all."""
    rows_of = {}
    written = lm_scoring.written

    def counted(df, label):
        out = written(df, label)
        rows_of[label] = out.count()
        return out

    df = few_words(spark)
    train = df.where("doc_id % 3 <> 1")
    want = {r.doc_id: r for r in lm_scoring.score_texts(df, train, rarest_pair=1).collect()}
    monkeypatch.setattr(lm_scoring, "written", counted)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 0.0033)  # about half of the words are not in the broadcast table
    got = {r.doc_id: r for r in lm_scoring.score_texts(df, train, max_bytes=64 << 10, rarest_pair=1).collect()}
    assert sum(rows_of.values()) < 1000 and len(got) == len(want) == 200
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[i].n_tokens, want[i].n_known, want[i].train_tokens)
        assert math.isclose(r.base_score, want[i].base_score, rel_tol=1e-9)
        assert abs(r.score - want[i].score) / r.n_tokens < 0.1


def test_shares_of_the_documents_ask_one_after_another(spark, monkeypatch, tmp_path):
    """op1: the questions of all documents never lie on disk at once, nor a second table of words; repeated and null keys keep their rows."""
    few = few_words(spark)
    again = few.where("doc_id < 20").union(few.where("doc_id >= 180").selectExpr("cast(null as long) as doc_id", "text"))
    few.union(again).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    train = df.where("doc_id % 3 <> 1")
    documents, labels, answers, written = [], [], lm_scoring.answers, lm_scoring.written

    def asked(rows, *args):
        documents.append(rows.where("kind = 0").count())
        return answers(rows, *args)

    def named(rows, label):
        labels.append(label)
        return written(rows, label)

    monkeypatch.setattr(lm_scoring, "answers", asked)
    monkeypatch.setattr(lm_scoring, "written", named)
    monkeypatch.setattr(lm_scoring, "FREQUENT", 0.0033)
    ask = lambda rows: [tuple(r) for r in lm_scoring.score_texts(rows, train, max_bytes=64 << 10, rarest_pair=1).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[4])
    got = sorted(ask(df), key=order)
    assert sum(documents) == 240 and max(documents) < 180 and "lm-words" not in labels
    documents.clear()
    want = sorted(ask(df.union(df.limit(0))), key=order)
    assert documents == [240] and len(got) == len(want) == 240
    for a, b in zip(got, want, strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9)


def test_open_words_and_weights_are_asked_in_packed_rows(spark, monkeypatch):
    """F1, op1: where words and weights are open too, no row for each document and open token is written, and the scores are those of filters that hold all."""
    rows_of, written = {}, lm_scoring.written

    def counted(df, label):
        out = written(df, label)
        rows_of[label] = rows_of.get(label, 0) + out.count()
        return out

    rnd = np.random.default_rng(19)
    texts = [" ".join(f"w{x}" for x in rnd.zipf(1.3, 200) % 30000) for _ in range(150)]
    texts += [None, "", "never seen", texts[3], texts[3] + " " + texts[4], " ".join(["twice unseen"] * 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = df.where("doc_id % 3 <> 1 and doc_id < 150")
    want = {r.doc_id: r for r in lm_scoring.score_texts(df, train, rarest_pair=1).collect()}
    model, *_ = lm_scoring.trained(train.select("text"), 8 << 10, 1)
    assert model.rest == {1, 2, 3} and model.least[1] > 2
    monkeypatch.setattr(lm_scoring, "written", counted)
    monkeypatch.setattr(lm_scoring, "CHUNK_KEYS", 64)  # many slots
    with lm_scoring.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "7"):  # parts of several batches
        got = {r.doc_id: r for r in lm_scoring.score_texts(df, train, max_bytes=8 << 10, rarest_pair=1).collect()}
    assert rows_of.keys() == {"lm-counts", "lm-weights", "lm-scores"} and rows_of["lm-scores"] == len(got) == len(want) == len(texts)
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[i].n_tokens, want[i].n_known, want[i].train_tokens)
        assert math.isclose(r.base_score, want[i].base_score, rel_tol=1e-9)
        assert abs(r.score - want[i].score) / r.n_tokens < 0.15


def test_answers_move_packed_to_the_part_that_asked(spark, monkeypatch):
    """F1, op1: answers took a row for each task and document; now one for each part and slot, and documents come back once without a grouping."""
    plans, answers = [], lm_scoring.answers

    def asked(rows, *args):
        out = answers(rows, *args)
        plans.append((rows.where("kind = 2").count(), rows.where("kind = 0").count(), out.count(), out._jdf.queryExecution().analyzed().toString()))
        return out

    monkeypatch.setattr(lm_scoring, "answers", asked)
    df = few_words(spark)
    lm_scoring.score_texts(df, df, max_bytes=64 << 10, rarest_pair=1)
    questions, documents, rows, plan = zip(*plans, strict=True)
    assert sum(documents) == sum(rows) == 200 and sum(questions) < 200 and "Aggregate" not in "".join(plan)


def test_words_are_hashed_together_as_one_by_one():
    """op1: XXH64 of words of all lengths, in all white space, without a Python object for each word."""
    rnd = np.random.default_rng(5)
    texts = [None, b"", b" \t\n", b" a", b"B b ", "\u00e9migr\u00e9 \u6f22\u5b57\u00a0x".encode(), *[b"Qz" * k + b"\x00 " for k in range(40)],
             *[bytes(rnd.choice(np.frombuffer(b"aZ09 \t\n\x0b\x0c\r\x1c\x00\x85\xc3\xa9bcdefghijk", np.uint8), n)) for n in (1, 7, 60, 500, 5000)]]
    h, n = lm_scoring.hashed(texts)
    words = [[xxhash.xxh64_intdigest(w.lower()) for w in (t or b"").split()] + [lm_scoring.END] for t in texts]
    assert n.tolist() == [len(w) for w in words] and h.tolist() == [x for w in words for x in w]
    assert [len(x) for x in lm_scoring.hashed([])] == [0, 0]
    long = [b" ".join(b"%d" % i for i in range(200_000))]
    tracemalloc.start()
    lm_scoring.hashed(long)
    assert tracemalloc.get_traced_memory()[1] < 20e6  # as bytes and cached hashes: over 30 MB
    tracemalloc.stop()


def test_batches_that_tasks_send_are_small(spark, monkeypatch):
    """op1: the JVM holds a whole batch outside its heap; the setting for scans ends with the call."""
    monkeypatch.setattr(lm_scoring, "SENT_BYTES", 1000)
    batch = pa.RecordBatch.from_pydict({"a": list(range(5000)), "b": [b"x" * (i % 7) for i in range(5000)]})
    parts = list(lm_scoring.sent(batch))
    assert len(parts) > 50 and max(x.nbytes for x in parts) < 2000 and pa.Table.from_batches(parts).combine_chunks().to_batches()[0].equals(batch)
    assert list(lm_scoring.sent(batch.slice(0, 0))) == []
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    df = few_words(spark)
    lm_scoring.score_texts(df, df, max_bytes=64 << 10, rarest_pair=1)
    assert spark.conf.get(name) == before


def test_lm_without_training_or_documents(docs, empty):
    assert lm_scoring.score_texts(empty, docs).collect() == []
    rows = lm_scoring.score_texts(docs, empty).collect()
    assert len(rows) == docs.count() and all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0) for r in rows)


# -- toxicity

def test_forward_backward_against_enumeration():
    import itertools
    rnd = np.random.default_rng(3)
    f = toxicity.Field()
    f.w, f.start, f.move = rnd.normal(size=(3, toxicity.LEVELS)), 0.3, rnd.normal(size=(2, 2))
    levels = [rnd.integers(0, toxicity.LEVELS, n).astype(np.int8) for n in (5, 1, 7, 3)]
    block = next(toxicity.blocks(np.array([len(x) for x in levels])))
    lev, active = toxicity.padded(levels, block)
    p, both = f.marginals(lev, active, pairs=True)
    total = np.zeros((2, 2))
    for j, i in enumerate(block):
        x = np.concatenate([[0], levels[i], [0]])
        weight, sums, pairs = 0.0, np.zeros(len(levels[i])), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=len(levels[i])):
            s = sum(f.w[0][x[t + 1]] + f.w[1][x[t]] + f.w[2][x[t + 2]] for t in range(len(y)) if y[t]) + y[0] * f.start
            s += sum(f.move[a, b] for a, b in zip(y, y[1:], strict=False))
            e = math.exp(s)
            weight, sums = weight + e, sums + e * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += e
        np.testing.assert_allclose(p[:len(sums), j], sums / weight, rtol=1e-9)
        total += pairs / weight
    np.testing.assert_allclose(both, total, rtol=1e-9)


def test_toxicity_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    scored = toxicity.score_toxicity(df, df.where(~held), labels.select(F.col("doc_id").alias("key"), "toxic"))
    rows = scored.where(held).join(labels, "doc_id").collect()
    hits = sum(r.predicted == r.toxic for r in rows)
    tp = sum(r.predicted and r.toxic for r in rows)
    assert hits / len(rows) > 0.96
    assert tp / max(1, sum(r.toxic for r in rows)) > 0.85 and tp / max(1, sum(r.predicted for r in rows)) > 0.75
    assert all(0 <= r.score <= 1 for r in rows)


def test_toxicity_fixture(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (2, 1)], "key long, toxic int")
    rows = toxicity.score_toxicity(docs, docs, labels).collect()
    assert len(rows) == docs.count() and len({r.score for r in rows}) == 1
    assert toxicity.score_toxicity(empty, docs, labels).collect() == []
    rows = toxicity.score_toxicity(docs, empty, labels.where("false")).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    train = spark.createDataFrame([(i, ("fine day vile word " if i % 4 == 0 else "fine day good word ") * 3 + f"w{i}") for i in range(400)], "doc_id long, text string")
    marks = train.selectExpr("doc_id as key", "cast(doc_id % 4 = 0 as int) as toxic")
    probe = spark.createDataFrame([(1, "such a vile word here"), (2, "such a good word here"), (3, ""), (4, None), (5, "x" * 100000)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.score_toxicity(probe, train, marks).collect()}
    assert got[1].predicted == 1 and got[1].spans.startswith("7:11") and got[2].predicted == got[3].predicted == got[4].predicted == 0
    assert got[3].score == got[4].score


# -- packing

def check_packing(rows, texts, capacity=1024):
    from tokenizers import Tokenizer
    import public_tokenizers
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    copies = Counter(i for i, _ in texts)
    for i, t in dict(texts).items():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        own = own[::copies[i]]
        assert [r.piece for r in own] == list(range(math.ceil(len(ids) / capacity)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (r.length == capacity or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in rows)
    return len(by_seq), math.ceil(total / capacity)


def test_packing_table(spark):
    df = real(spark)
    n, least = check_packing(packing.pack_documents(df).collect(), [(r.doc_id, r.text) for r in df.collect()])
    assert n <= least * 1.003 + 1


def test_packing_fixture(docs, empty):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    n, least = check_packing(packing.pack_documents(docs).collect(), texts)
    assert n <= least + 1
    assert packing.pack_documents(empty).collect() == []


@pytest.mark.parametrize("kind", ["mixed", "large", "equal"])
def test_rounds_and_counts(spark, monkeypatch, kind):
    monkeypatch.setattr(packing, "GROUP", 150)
    rnd = np.random.default_rng(2)
    sizes = {"mixed": rnd.integers(1, 60, 3000), "large": rnd.integers(52, 100, 3000), "equal": np.full(3000, 34)}[kind]
    df = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, size long")
    rows = {r.uid: r for r in packing.pack(df, 100).collect()}
    assert len(rows) == 3000
    bins = defaultdict(list)
    for i, s in enumerate(sizes.tolist()):
        bins[rows[i].sequence_id].append((rows[i].offset, s))
    for spans in bins.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= 100
    _, _, fills = packing.best_fit(sizes, 100)
    assert len(bins) <= len(fills) * 1.01 + 2


def test_best_fit_by_counts_equals_items():
    rnd = np.random.default_rng(4)
    sizes = rnd.integers(1, 100, 500)
    runs = packing.plan_counts(dict(Counter(sizes.tolist())), 100)
    fill = Counter()
    seen = Counter()
    for size, rank, n, first, offset in sorted(runs, key=lambda r: (r[4])):
        seen[size] += n
        for j in range(n):
            assert fill[first + j] == offset
            fill[first + j] += size
    assert seen == Counter(sizes.tolist()) and max(fill.values()) <= 100
    assert len(fill) <= len(packing.best_fit(sizes, 100)[2]) + 2


# -- quality rules

def test_counts(spark, docs):
    for df in (docs, real(spark)):
        labels = spark.createDataFrame([], "key long, quality int")
        texts = {r.doc_id: r.text for r in df.collect()}
        rows = quality_rules.judge(df, labels).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = brute.quality_counts(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
            assert r.base_failed == failed and r.kept == (not failed)


def test_tail_is_exact():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.01), (30, 30, 0.4), (0, 0, 0.1)):
        assert math.isclose(quality_rules.tail(k, n, p), min(1, sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))), rel_tol=1e-9)


def test_thresholds_limit_false_rejection(spark):
    import random
    rnd = random.Random(1)
    rows = []
    for i in range(6000):
        bad = i % 5 == 0
        w = [f"w{rnd.randrange(5000)}" for _ in range(40)]
        if bad:
            w = [x + "###" for x in w]
        elif rnd.random() < 0.002:
            w[0] += "#" * 30
        rows.append((i, " ".join(w), ["en", "de", None][i % 3], 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, q int")
    labels = df.where("doc_id < 5000").selectExpr("doc_id as key", "q as quality")
    got = {r.doc_id: r.kept for r in quality_rules.judge(df, labels, max_false_rejection=0.1).collect()}
    assert not any(got[i] for i, *_, q in rows if q == 0)
    good = [got[i] for i, *_, q in rows if q == 1]
    assert sum(good) / len(good) > 0.98
    few = {r.doc_id: r.kept for r in quality_rules.judge(df, labels.where("key < 100")).collect()}
    assert all(few.values())  # too few holdouts to guarantee anything
    kept = quality_rules.keep_good(df, labels, max_false_rejection=0.1)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in got.items() if k)


def test_quality_empty(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 0), (2, None)], "key long, quality int")
    assert quality_rules.judge(empty, labels).collect() == []
    assert quality_rules.keep_good(docs, labels).columns == docs.columns


# -- SimHash

def check_components(df, got):
    prints = Counter()
    first = {}
    texts = {}
    for r in df.collect():
        fp = brute.fingerprint(r.text)
        texts[r.doc_id] = fp
        if r.doc_id is not None:
            first[fp] = min(first.get(fp, r.doc_id), r.doc_id)
        prints[fp] += 1
    groups = brute.clusters(prints)
    leader = defaultdict(list)
    for fp, g in groups.items():
        if fp in first:
            leader[g].append(first[fp])
    assert len(got) == sum(prints.values())
    for r in got:
        fp = texts[r.doc_id]
        assert r.fingerprint == f"{fp:016x}"
        assert r.component_id == (min(leader[groups[fp]]) if leader[groups[fp]] else None)


def test_simhash(spark, docs, empty):
    for df in (docs, real(spark)):
        check_components(df, simhash_dedup.near_duplicates(df).collect())
    assert simhash_dedup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("star", [65, 0, 10 ** 9])
def test_links_by_probes_and_balls(spark, monkeypatch, star):
    """Chains, dense balls and skewed parts, with all fingerprints on either way and with both."""
    rnd = np.random.default_rng(7)
    seeds = rnd.integers(0, 2 ** 63, 40).tolist() + [0, 2 ** 64 - 1]
    prints = set(seeds)
    for s in seeds[:12]:
        x = s
        for _ in range(60):
            x ^= 1 << int(rnd.integers(0, 64 if s % 2 else 20))
            if rnd.random() < 0.5:
                x ^= 1 << int(rnd.integers(0, 64))
            prints.add(x)
    signed = [p - 2 ** 64 if p >= 2 ** 63 else p for p in prints]
    if star != 65:
        monkeypatch.setattr(simhash_dedup, "BALL_COST", star)
    edges = simhash_dedup.links(spark.createDataFrame([(p,) for p in signed], "fp long")).distinct().collect()
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        assert ((e.a ^ e.b) & (2 ** 64 - 1)).bit_count() <= 2
        root[find(e.a)] = find(e.b)
    want = brute.clusters(prints)
    same = defaultdict(set)
    for p in prints:
        same[want[p]].add(find(p - 2 ** 64 if p >= 2 ** 63 else p))
    assert all(len(v) == 1 for v in same.values()) and len({min(v) for v in same.values()}) == len(same)


def test_dynamic_programming():
    import itertools
    rnd = np.random.default_rng(5)
    costs = rnd.random((50, 3, 4))
    t, cost = simhash_dedup.allocate(costs, 0)
    for q in range(50):
        best = min(sum(costs[q, i, x + 1] for i, x in enumerate(c)) for c in itertools.product(range(-1, 3), repeat=3) if sum(c) == 0)
        assert math.isclose(best, cost[q]) and t[q].sum() == 0
        assert math.isclose(sum(costs[q, i, t[q, i] + 1] for i in range(3)), cost[q])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 260)] + [(-5, 250), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(101)) and all(got[i] == -5 for i in range(200, 260)) and got[301] == 300 and len(got) == 164


def test_keep_one(spark, docs):
    for df in (docs, real(spark)):
        kept = simhash_dedup.keep_one(df)
        assert kept.columns == df.columns
        found = simhash_dedup.near_duplicates(df).collect()
        leaders = {r.component_id for r in found if r.component_id is not None}
        assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(leaders)


# -- top-k

def plain_top(rows, k=10, step=100):
    vecs = {i: (key, [math.floor(1024 * x) for x in v]) for i, (key, v) in enumerate(rows)
            if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, (key, q) in vecs.items():
        if key is None or key % step:
            continue
        s = [(-sum(a * b for a, b in zip(q, v, strict=True)), kk is None, kk or 0, j) for j, (kk, v) in vecs.items() if j != i and len(v) == len(q)]
        out += [(key, r + 1, None if n else kk, -x) for r, (x, n, kk, _) in enumerate(sorted(s)[:k])]
    return sorted(out, key=str)


def test_topk(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rnd.normal(size=(700, 8)) * rnd.lognormal(0, 1, (700, 1)))]
    rows += [(700 + i, rows[3][1]) for i in range(50)] + [(800, None), (801, [None] * 8), (802, [float("nan")] * 8), (803, [float("inf")] * 8),
             (None, rows[5][1]), (900, [0.0] * 8), (1000, [1.0, 2.0]), (1001, [2.0, 2.0]), (1100, []), (1200, [3e30, 1.0, *[0.0] * 6]), (300, rows[300][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for size, block in ((2048, 1024), (64, 2)):
        monkeypatch.setattr(topk_search, "BUCKET", size)
        monkeypatch.setattr(topk_search, "QUERIES", block)
        got = topk_search.top_products(df.repartition(3)).collect()
        want = plain_top(rows)
        big = lambda rs: sorted((r for r in rs if abs(r[3]) < 2 ** 62), key=str)
        assert big([(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id != 1200]) == big([r for r in want if r[0] != 1200])
    assert topk_search.top_products(df.where("false")).collect() == []


def test_pruning_prunes(spark):
    rnd = np.random.default_rng(1)
    cand = rnd.normal(size=(3000, 16))
    cand[:40] = cand[0] + 0.3 * cand[:40]
    cand /= np.linalg.norm(cand, axis=1)[:, None] / rnd.uniform(0.8, 1, (3000, 1))
    cand = cand[np.argsort(-np.linalg.norm(cand, axis=1))]
    norms = np.linalg.norm(cand, axis=1)
    q = cand[np.argmax((cand @ cand.T > 0.6).sum(axis=0))]
    scores = cand @ q
    bound = np.sort(scores)[-10]
    at = topk_search.search_bucket(cand, norms, q, bound)
    assert set(np.flatnonzero(scores >= bound)) <= set(at) and len(at) < 1500
