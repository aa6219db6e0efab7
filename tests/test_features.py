import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tidewatch.operators import attribution as X
from tidewatch.operators import features as FT
from tidewatch.operators import impute as I


def test_linear_attribution_adds_up(spark):
    df = spark.createDataFrame([(1, 1.0, 10.0), (2, 3.0, 0.0), (3, 5.0, 20.0)], "id int, a double, b double")
    w, b = {"a": 0.5, "b": -0.1}, 0.2
    phi, base = X.linear_attribution(df, ["id"], w, b)
    base_v = base.collect()[0].base_value
    assert base_v == pytest.approx(0.5 * 3.0 - 0.1 * 10.0 + 0.2)
    sums = {r.id: r.s for r in phi.groupBy("id").agg(F.sum("phi").alias("s")).collect()}
    for r in df.collect():
        assert sums[r.id] + base_v == pytest.approx(0.5 * r.a - 0.1 * r.b + 0.2)
    rows, _ = X.linear_rows(df.union(df), ["id"], w, b)  # repeated keys stay rows of their own
    top = X.exploded(X.top_n_with_others(rows, feature="slot", top_n=1)).where("id = 3").collect()
    assert sorted(x.name for x in top) == ["a", "a", "others", "others"]
    folded = X.exploded(X.fold_slots(rows, {"a": "f", "b": "f"}))
    assert folded.count() == 6


def test_stratified_split_shares(spark):
    lb = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    s = FT.hash_rank_split(lb, ["doc_id"], "quality", 0.2, 42)
    per = {r.quality: (r.n, r.t) for r in s.groupBy("quality").agg(F.count(F.lit(1)).alias("n"),
                                                                   F.count_if("is_test").alias("t")).collect()}
    for n, t in per.values():
        assert t == round(n * 0.2)
    again = FT.hash_rank_split(lb.repartition(5), ["doc_id"], "quality", 0.2, 42)
    assert sorted(r.doc_id for r in s.where("is_test").collect()) == sorted(r.doc_id for r in again.where("is_test").collect())
    tiny = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, quality int")
    assert FT.hash_rank_split(tiny, ["doc_id"], "quality", 0.2).where("is_test").count() == 0


def test_imputation_rules(spark):
    df = spark.createDataFrame([(1.0, "b", None), (None, "a", None), (3.0, None, None), (10.0, "b", None)],
                               "x double, s string, empty string")
    out = {i: r for i, r in enumerate(I.impute(df).collect())}
    assert out[1].x == 3.0               # median of 1, 3, 10
    assert out[2].s == "b"               # most frequent
    assert out[0].empty == "NO"          # all-null text column
    ties = spark.createDataFrame([("z",), ("a",), ("z",), ("a",), (None,)], "s string")
    assert I.impute(ties).collect()[4].s == "a"  # tie -> smallest value


def test_sparse_rows_and_vectors_equal_the_columns(spark):
    """Nulls, a level unseen in fitting, a column without values; the three forms agree, and the names are in slot order."""
    rows = [(1, 1.0, "b", "YES", None), (2, None, "a", "NO", None), (3, 5.0, None, None, None), (4, 2.0, "a", "YES", None)]
    df = spark.createDataFrame(rows, "id long, x double, s string, f string, none string")
    pre = FT.fit_preprocessor(df, [], numeric=["x"], categorical=["s", "none"], binary=["f"])
    assert pre.slot_names() == ["x", "s_a", "s_b", "f_YES"] == [r.name for r in pre.slot_table().orderBy("slot").collect()]
    assert {(r.slot, r.feature) for r in pre.slot_map(spark).collect()} == {("x", "x"), ("s_a", "s"), ("s_b", "s"), ("f_YES", "f")}
    new = df.unionByName(spark.createDataFrame([(5, 1.0, "unseen", "MAYBE", None)], df.schema))
    wide = {r.id: [0.0 if v is None else v for v in r[1:]] for r in FT.transform(pre, new, ["id"]).collect()}
    for r in FT.sparse(pre, new, ["id"]).collect():
        dense = [0.0] * pre.size
        for s, v in zip(r.slots, r["values"]):
            dense[s] = v
        assert dense == wide[r.id]
    assert {r.id: list(r.features.toArray()) for r in FT.vectors(pre, new, ["id"]).collect()} == wide
    assert len(wide) == 5 and wide[5][1:] == [0.0, 0.0, 0.0]


def test_columns_of_very_many_levels_stay_sparse(spark):
    df = spark.range(100000).select("id", F.concat(F.lit("v"), "id").alias("s"))
    pre = FT.fit_preprocessor(df, [], numeric=[], categorical=["s"], binary=[])
    assert pre.size == 100000 and FT.sparse(pre, df, ["id"]).agg(F.countDistinct(F.get("slots", F.lit(0)))).first()[0] == 100000
    first = FT.vectors(pre, df.where("id = 99999"), ["id"]).first().features
    assert first.size == 100000 and list(first.indices) == [99999]  # the last in text order
    with pytest.raises(ValueError):
        FT.transform(pre, df)


def test_fitting_reads_its_rows_once_for_each_kind_of_count(spark, tmp_path):
    """The fitted parameters are data: using them doesn't read the training rows again."""
    rows = [(1, 1.0, "b", "YES"), (2, None, "a", None), (3, 5.0, None, "NO"), (4, 2.0, "a", "YES")]
    spark.createDataFrame(rows, "id long, x double, s string, f string").write.parquet(f"{tmp_path}/train")
    df = spark.read.parquet(f"{tmp_path}/train")
    pre = FT.fit_preprocessor(df, [], numeric=["x"], categorical=["s"], binary=["f"])
    for fitted in (pre.params, pre.slots):
        assert fitted.inputFiles() and not [f for f in fitted.inputFiles() if str(tmp_path) in f]
    p = pre.params.first()
    assert (p["__med_0"], p["__mean_0"], p["__mode_0"]) == (2.0, 2.5, "a") and p["__std_0"] == pytest.approx(1.5)
