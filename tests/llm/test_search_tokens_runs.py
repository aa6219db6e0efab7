"""Lexical search, token counts and periodic runs against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tidewatch.llm import lexical_search, periodic_runs, token_counts
from tidewatch.llm.queries import op13_periodic_runs, with_planted_runs

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def real(spark, name="documents"):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# -- lexical search

def ranked(docs, queries, k):
    """Every document against every query: sorted (query number, rank, key, score)."""
    counts = [Counter(TERM.findall((t or "").translate(brute.AZ))) for _, t in docs]
    sizes = [sum(c.values()) for c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in counts for t in c)
    out = []
    for number, (_, text) in enumerate(queries):
        terms = {t for t in TERM.findall((text or "").translate(brute.AZ)) if t in df}
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in terms}
        found = []
        for (key, _), c, s in zip(docs, counts, sizes, strict=True):
            m = 10 + 90 * s * n // max(total, 1)
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if score > 0:
                found.append((-score, key is None, key or 0, key))
        out += [(number, i + 1, f[3], -f[0]) for i, f in enumerate(sorted(found)[:k])]
    return out


@pytest.mark.parametrize("k", [1, 3, 50])
def test_search_equals_scoring_everything(spark, docs, texts, monkeypatch, k):
    """Nulls, empties, repeats and null keys on both sides, several segments, several blocks of queries."""
    monkeypatch.setattr(lexical_search, "SEGMENT_DOCS", 7)
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)
    asked = [(i, t) for i, t in enumerate(texts[:20])] + [(3, texts[12]), (None, "alpha beta")]
    queries = spark.createDataFrame([(i, t, 1, "x") for i, t in asked], "item_id long, text string, query int, key string")
    rows = lexical_search.top_documents(docs, queries, k).collect()
    expected = ranked([(r.doc_id, r.text) for r in docs.collect()], asked, k)
    assert sorted((r.item_id is None, r.item_id or 0, r["rank"], r.doc_id is None, r.doc_id or 0, r.score) for r in rows) == sorted(
        (asked[q][0] is None, asked[q][0] or 0, rank, key is None, key or 0, score) for q, rank, key, score in expected)


def test_search_of_empty_tables(spark, docs, empty):
    queries = spark.createDataFrame([(1, "alpha")], "item_id long, text string")
    assert lexical_search.top_documents(empty, queries).count() == 0
    out = lexical_search.top_documents(docs, queries.where("false"))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def segment(bodies, asked):
    """An index row of one segment of bodies, with pairs for the asked queries."""
    vocabulary = {w: i for i, w in enumerate(sorted({t for q in asked for t in lexical_search.terms_of(q)}))}
    s = lexical_search.Segment(vocabulary)
    for i, b in enumerate(bodies):
        s.add(i, b)
    return s, [np.array([vocabulary[t] for t in dict.fromkeys(lexical_search.terms_of(q))], np.int64) for q in asked]


def test_pair_bounds_hold_and_tighten(spark):
    """The rest's bound is never below a document's real rest, and pairs that never meet make it smaller than the sum."""
    rnd = random.Random(5)
    bodies = [" ".join(rnd.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=rnd.randrange(1, 9))) for _ in range(60)]
    s, asked = segment(bodies, ["a b c d e f g h", "h g f", "a h"])
    parts = spark.createDataFrame([s.row()], lexical_search.SEGMENT)
    n, total, df = lexical_search.statistics(parts, 8)
    assert (n, total) == (60, sum(len(b.split()) for b in bodies))
    assert df.tolist() == [sum(t in b.split() for b in bodies) for t in "abcdefgh"]
    weight = lexical_search.weights(n, df)
    row = lexical_search.build_index(parts, n, total, weight, lexical_search.weighty_pairs(asked, weight)).collect()[0]
    searcher = lexical_search.Searcher(row)
    tighter = 0
    for terms in asked:
        terms = sorted(terms.tolist(), key=lambda t: -searcher.top[t])
        rest = searcher.bounds(terms)
        for i in range(len(terms)):
            real_rest = searcher.scores(terms[i:], np.arange(60)).max()
            assert real_rest <= rest[i] <= sum(searcher.top[t] for t in terms[i:])
            tighter += rest[i] < sum(searcher.top[t] for t in terms[i:])
    assert tighter


# -- token counts

def test_counts_equal_the_tokenizers(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (docs, real(spark)):
        texts = [r.text or "" for r in df.collect()]
        expected = [(len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for t in texts]
        rows = token_counts.count_tokens(df).collect()
        assert [(r.n_bytes, r.n_tokens) for r in rows] == expected
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_counts_of_hostile_texts(monkeypatch):
    """Single pre-tokens of 30,000 letters, runs of one letter, all kinds of spaces, special strings; a small memory."""
    import public_tokenizers
    from tokenizers import Tokenizer
    monkeypatch.setattr(token_counts, "REMEMBERED", 50)
    monkeypatch.setattr(token_counts, "WAITING", 500)
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("aab \n\t'sé漢😀<|>\u0085 ​\u001c", k=rnd.randrange(300))) for _ in range(500)]
    texts += ["a" * 30000, "ab" * 9999, "漢字" * 5000, "".join(rnd.choices("abcdefghij", k=30000)), " " * 20000, "<|endoftext|>" * 3 + "x <|endoftext|>", "", None]
    texts += ["a" + chr(c) + "1" + chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    counter = token_counts.Counter(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert counter(texts).tolist() == expected


def test_counts_of_an_empty_table(empty):
    out = token_counts.count_tokens(empty)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and out.count() == 0


# -- periodic runs

def runs_of(words, min_length=24, min_periods=3):
    """All lags one by one; a lag counts where no smaller lag is a period of the stretch."""
    seen = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words])
    out = []
    for q in range(1, len(words) // min_periods + 1):
        edges = np.flatnonzero(np.diff(np.r_[False, ids[:-q] == ids[q:], False].astype(int)))
        for start, end in edges.reshape(-1, 2).tolist():
            part = words[start:end + q]
            if len(part) >= max(min_length, min_periods * q) and not any(part[:-d] == part[d:] for d in range(1, q)):
                out.append((start, len(part), q))
    return sorted(out)


def collapsed(words, runs):
    gone = {x for s, n, q in runs for x in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts():
    rnd = random.Random(3)
    texts = [["x"] * 90, ["x"] * 23, list("ab" * 12), list("abc" * 8) + list("bca" * 9), []]
    a, b = "a", "ab"
    for _ in range(11):
        a, b = b, b + a
    texts.append(list(b))  # a Fibonacci word, full of runs that overlap
    for _ in range(250):
        kinds, words = rnd.choice([1, 2, 3, 50]), []
        for _ in range(rnd.randrange(6)):
            part = [str(rnd.randrange(kinds)) for _ in range(rnd.randrange(1, 60))]
            words += (part * 6)[:rnd.randrange(1, 6 * len(part) + 1)] + [str(rnd.randrange(kinds)) for _ in range(rnd.randrange(5))]
        texts.append(words)
    return texts


@pytest.mark.parametrize("min_length, min_periods", [(24, 3), (3, 3), (9, 4)])
def test_runs_equal_all_lags(monkeypatch, min_length, min_periods):
    monkeypatch.setattr(periodic_runs, "CHUNK", 2000)
    texts = [t for t in periodic_texts() if len(t) < 300 or min_length > 9]
    found = periodic_runs.Finder(min_length, min_periods)([" \n".join(t) for t in texts])
    assert sum(map(len, found["starts"])) > 50
    for words, row in zip(texts, found.itertuples(index=False), strict=True):
        expected = runs_of(words, min_length, min_periods)
        assert list(zip(row.starts, row.lengths, row.periods, strict=True)) == expected
        assert row.collapsed == collapsed(words, expected)


def test_runs_of_a_table(spark, docs, texts):
    rows = periodic_runs.periodic_runs(docs).collect()
    assert len(rows) == len(texts) + 2
    for r, t in zip(rows, docs.collect(), strict=True):
        words = brute.words(t.text)
        expected = runs_of(words)
        assert r.doc_id == t.doc_id and [tuple(x) for x in r.runs] == expected and r.collapsed == collapsed(words, expected)
    assert max(len(r.runs) for r in rows) > 0
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(docs, min_periods=2)


def test_runs_of_an_empty_table(empty):
    out = periodic_runs.periodic_runs(empty)
    assert out.columns == ["doc_id", "runs", "collapsed"] and out.count() == 0


def planted(key, words):
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_query_of_planted_runs(spark, docs, tmp_path):
    """The contract's columns by their definitions, on the fixture and on a table."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        source = spark.read.parquet(f"{folder}/documents.parquet")
        texts = [(r.doc_id, planted(r.doc_id, brute.words(r.text))) for r in source.collect()]
        assert sorted((k or -1, brute.words(t)) for k, t in with_planted_runs(source).collect()) == sorted((k or -1, w) for k, w in texts)
        expected = []
        for key, words in texts:
            runs = runs_of(words)
            best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
            digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
            milli = best[1] * 1000 // best[2] if runs else None
            expected.append((key, len(runs), *best, milli, digest, hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
        rows = [tuple(r) for r in op13_periodic_runs(spark, folder).collect()]
        assert sorted(map(str, rows)) == sorted(map(str, expected))
        assert any(r[1] for r in rows)
