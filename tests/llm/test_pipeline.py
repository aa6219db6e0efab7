from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import brute
from tests.llm.test_native import check_mix
from tests.llm.test_python import check_packing
from tidewatch.llm import mixing, quality_rules

SF = "/root/testdata/sf0.01"


def test_all_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "pii", "mixing", "best-fit packing"]


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        docs, was = spark.read.parquet(str(tmp_path / str(k))), docs
        rows = docs.collect()
        if name == "quality rules":
            # too few labels at this size for a cutoff: the base rules decide
            for i, r in before.items():
                n, _, _, _, again = brute.quality_counts(r.text)
                assert (n < 10 or 100 * again > 20 * n) == (i not in {x.doc_id for x in rows}), i
        elif name == "simhash near-dedup":
            prints = {r.doc_id: brute.fingerprint(r.text) for r in was.collect()}
            groups = brute.clusters(set(prints.values()))
            least = {}
            for i, p in prints.items():
                least[groups[p]] = min(i, least.get(groups[p], i))
            assert sorted(r.doc_id for r in rows) == sorted(least.values())
        elif name == "pii":
            texts = {r.doc_id: r.text for r in was.collect()}
            for r in rows:
                spans = sorted((a, b, kk) for kk, a, b in brute.base_pii(texts[r.doc_id]))
                want, at = "", 0
                for a, b, kk in spans:
                    a = max(a, at)
                    if a < b:
                        want += texts[r.doc_id][at:a] + "<" + ("EMAIL", "IP", "CARD", "PHONE")[kk] + ">"
                        at = b
                assert r.text == want + texts[r.doc_id][at:] and r.n_chars == len(r.text)
        elif name == "mixing":
            taken = mixing.mix_sources(was).collect()
            check_mix(taken, None)
            words = Counter()
            for r in rows:
                words[r.doc_id] += len(brute.words(r.text))
            assert +words == +Counter({r.doc_id: r.taken for r in taken})
        else:
            texts = was.collect()
            total = Counter(r.doc_id for r in texts)
            n, least = check_packing(rows, [(r.doc_id, r.text) for r in texts if total[r.doc_id] == 1])
            assert n <= least * 1.004 + 1


def test_run_equals_the_stages_one_by_one(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    again = entry.queries()["pipeline"](spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) > 900


def test_pipeline_on_nulls_repeats_and_nothing(spark, docs, empty, tmp_path):
    for k, table in enumerate((docs, empty)):
        d = str(tmp_path / str(k))
        table.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        rows = corpus_pipeline.run(spark, d).collect()
        assert (len(rows) > 0) == (k == 0)


def stages():
    return list(zip("abcd", (s for _, s in corpus_pipeline.STAGES[:4]), strict=True))


def test_stages_keep_columns_of_any_name(spark, docs):
    """Names that the stages might use themselves, and one with a dot, keep their values."""
    names = ["_row", "_s", "_size", "_cuts", "_steps", "_stratum", "_range", "own", "group", "digest", "ranges", "cuts", "stratum", "fp", "a.b"]
    extra = docs.where("doc_id is not null").withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for name, stage in stages():
        if name == "a":
            out = quality_rules.keep_good(extra, labels.withColumnRenamed("doc_id", "key"))
        else:
            out = stage(spark, extra, SF)
        assert out.columns == extra.columns and out.dtypes == extra.dtypes
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_stages_when_cores_are_lost_between_scans(spark, tmp_path):
    """The plan is made with many splits of many files and run with few, as when executors go."""
    path = str(tmp_path / "documents")
    spark.read.parquet(f"{SF}/documents.parquet").repartition(12, "doc_id").write.parquet(path)
    key = "spark.sql.leafNodeDefaultParallelism"
    for name, stage in stages():
        counts = []
        for later in (None, 1):
            try:
                out = stage(spark, spark.read.parquet(path), SF)
                if later:
                    spark.conf.set(key, later)
                counts.append(sorted((r.doc_id, r.text or "") for r in out.collect()))
            finally:
                spark.conf.unset(key)
        assert counts[0] == counts[1] and len(counts[0]) > 700
