import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import normal_frame
from tidewatch.functions.special import chi2_sf, ks_pvalue
from tidewatch.operators import drift as D
from tidewatch.operators.ladder import quantiles_linear, value_ladder


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_chi2_sf_known_values(spark):
    r = one(spark.range(1).select(
        chi2_sf(F.lit(3.841458820694124), F.lit(1)).alias("p1"),
        chi2_sf(F.lit(2.0), F.lit(3)).alias("p3"),
        chi2_sf(F.lit(10.0), F.lit(4)).alias("p4"),
        chi2_sf(F.lit(150.0), F.lit(99)).alias("p99"),
        chi2_sf(F.lit(0.0), F.lit(5)).alias("p0")))
    assert r.p1 == pytest.approx(0.05, abs=1e-12)
    assert r.p3 == pytest.approx(0.5724067044708798, rel=1e-10)
    assert r.p4 == pytest.approx(math.exp(-5.0) * 6.0, rel=1e-12)
    assert 0.0005 < r.p99 < 0.001
    assert r.p0 == 1.0


def test_ks_pvalue_limits(spark):
    r = one(spark.range(1).select(ks_pvalue(F.lit(0.0), F.lit(100), F.lit(100)).alias("same"),
                                  ks_pvalue(F.lit(1.0), F.lit(1000), F.lit(1000)).alias("disjoint")))
    assert r.same == 1.0
    assert r.disjoint == pytest.approx(0.0, abs=1e-12)


def test_ks_identical_and_shifted(spark):
    ref = normal_frame(spark, 1000, seed=1)
    same = D.ks_two_sample(ref, ref, "value").collect()[0]
    assert same.statistic == 0.0 and same.p_value == 1.0 and not same.drift_detected
    shifted = D.ks_two_sample(ref, normal_frame(spark, 1000, mean=5.0, seed=2), "value").collect()[0]
    assert shifted.statistic > 0.9 and shifted.drift_detected


def test_ladder_buckets_do_not_change_results(spark):
    ref = normal_frame(spark, 3000, seed=3)
    cur = normal_frame(spark, 2000, mean=0.3, seed=4)
    counts = D.numeric_counts(ref, cur, ["value"])
    ks1 = D.ks_from_ladder(value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur"], buckets=1)).collect()[0]
    ks64 = D.ks_from_ladder(value_ladder(counts, ["feature"], "value", ["n_ref", "n_cur"], buckets=64)).collect()[0]
    assert ks1.statistic == pytest.approx(ks64.statistic, abs=1e-15)
    probs = spark.createDataFrame([("value", 3000, [0.0, 0.25, 0.5, 0.9, 1.0])], "feature string, n long, probs array<double>")
    q1 = quantiles_linear(value_ladder(counts, ["feature"], "value", ["n_ref"], buckets=1), ["feature"], "value", "n_ref", probs)
    q64 = quantiles_linear(value_ladder(counts, ["feature"], "value", ["n_ref"], buckets=64), ["feature"], "value", "n_ref", probs)
    assert q1.collect()[0].quantiles == pytest.approx(q64.collect()[0].quantiles)


def test_exact_quantiles_match_linear_interpolation(spark):
    vals = [5.0, 1.0, 3.0, 3.0, 9.0, 2.0, 7.5]
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    counts = D.numeric_counts(df, df.limit(0), ["value"])
    probs = spark.createDataFrame([("value", len(vals), [0.1, 0.5, 0.75])], "feature string, n long, probs array<double>")
    q = quantiles_linear(value_ladder(counts, ["feature"], "value", ["n_ref"], buckets=1), ["feature"], "value", "n_ref",
                         probs).collect()[0].quantiles
    s = sorted(vals)

    def lin(p):
        h = (len(s) - 1) * p
        lo = math.floor(h)
        hi = min(lo + 1, len(s) - 1)
        return s[lo] + (s[hi] - s[lo]) * (h - lo)
    assert q == pytest.approx([lin(0.1), lin(0.5), lin(0.75)])


def test_chi_square_equal_and_different(spark):
    a = spark.createDataFrame([("a",)] * 250 + [("b",)] * 250, "value string")
    same = D.categorical_two_sample(a, a, "value").collect()[0]
    assert same.chi_stat == pytest.approx(0.0) and same.chi_p == pytest.approx(1.0)
    b = spark.createDataFrame([("a",)] * 100 + [("b",)] * 900, "value string")
    c = spark.createDataFrame([("a",)] * 500 + [("b",)] * 500, "value string")
    diff = D.categorical_two_sample(c, b, "value").collect()[0]
    # 2 x 2 table, dof 1: closed form p = erfc(sqrt(x / 2))
    assert diff.chi_p == pytest.approx(math.erfc(math.sqrt(diff.chi_stat / 2)), rel=1e-9, abs=1e-300)
    assert diff.chi_p < 0.05


def test_chi_square_small_sample_guard(spark):
    a = spark.createDataFrame([("a",), ("b",)], "value string")
    b = spark.createDataFrame([("a",)], "value string")
    # table [[1, 1], [1, 0]]: smallest expected count 1 * 1 / 3
    r = D.categorical_two_sample(a, b, "value").collect()[0]
    assert r.chi_stat is None and r.chi_info.startswith("min_expected=0.33 < 1")


def test_psi_equal_shifted_and_small(spark):
    ref = normal_frame(spark, 10000, seed=5)
    same = D.psi_two_sample(ref, ref, "value").collect()[0]
    assert same.statistic == pytest.approx(0.0, abs=1e-12)
    shifted = D.psi_two_sample(ref, normal_frame(spark, 10000, mean=3.0, seed=6), "value").collect()[0]
    assert shifted.statistic > 0.1 and shifted.drift_detected
    small = D.psi_two_sample(ref, normal_frame(spark, 30, seed=7), "value").collect()[0]
    assert small.statistic is None and small.info == "window too small for PSI (n<50)"


def test_categorical_psi(spark):
    a = spark.createDataFrame([("YES",)] * 900 + [("NO",)] * 100, "value string")
    b = spark.createDataFrame([("YES",)] * 100 + [("NO",)] * 900, "value string")
    r = D.categorical_two_sample(a, b, "value").collect()[0]
    expected = (0.9 - 0.1) * math.log(0.9 / 0.1) + (0.1 - 0.9) * math.log(0.1 / 0.9)
    assert r.cpsi == pytest.approx(expected)
    # metamorphic: swapping sides keeps categorical PSI
    r2 = D.categorical_two_sample(b, a, "value").collect()[0]
    assert r2.cpsi == pytest.approx(r.cpsi)


def test_js_distance(spark):
    ref = normal_frame(spark, 10000, seed=8)
    far = D.js_distance(ref, normal_frame(spark, 10000, mean=5.0, seed=9), ["value"]).collect()[0]
    assert far.statistic > 0.1 and far.drift_detected
    near = D.js_distance(ref, normal_frame(spark, 10000, seed=10), ["value"]).collect()[0]
    assert near.statistic < 0.1


def test_table_drift_and_subsets(spark):
    ref = normal_frame(spark, 500, seed=11, name="age").join(
        normal_frame(spark, 500, mean=20, sd=3, seed=12, name="bmi").withColumn("id", F.monotonically_increasing_id()),
        how="left", on=F.lit(False)).select("age", F.lit(20.0).alias("bmi"))
    ref = ref.withColumn("sex", F.when(F.col("age") > 0, "M").otherwise("F")).withColumn("const", F.lit(1))
    cur = ref.withColumn("age", F.col("age") + 3).withColumn("sex", F.lit("M"))
    rep = D.data_drift(ref, cur, ["age", "sex", "const", "missing"])
    feats = {r.feature: r for r in rep.features.collect()}
    assert feats["age"].drift_detected and feats["sex"].drift_detected
    assert feats["const"].feature_type == "constant" and not feats["const"].drift_detected
    assert feats["missing"].error == "missing column"
    s = rep.summary.collect()[0]
    assert s.n_features == 4 and s.drift_count == 2 and s.data_drift_detected
    same = D.data_drift(ref, ref, ["age", "sex"]).summary.collect()[0]
    assert not same.data_drift_detected and same.drift_ratio == 0.0


def test_drift_invariant_under_repartition(spark):
    ref = normal_frame(spark, 2000, seed=13)
    cur = normal_frame(spark, 1500, mean=0.2, seed=14)
    a = D.data_drift(ref, cur, ["value"]).tests.orderBy("test").collect()
    b = D.data_drift(ref.repartition(7), cur.repartition(3), ["value"]).tests.orderBy("test").collect()
    assert [(r.test, round(r.statistic, 12)) for r in a] == [(r.test, round(r.statistic, 12)) for r in b]
