import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_CHECK
from tidewatch.operators import drift as D
from tidewatch.operators import inject as G
from tidewatch.operators import monitor as T
from tidewatch.plans import window_plans as W


def test_windowed_tests_equal_batch_tests_per_window(spark):
    ref, cur = W.split(spark, SF_CHECK)
    rep = T.windowed_data_drift(ref, cur, "ts", W.FEATURES, duration="1 day")
    day = "2024-01-20"
    win = rep.tests.where(F.date_format(T.WKEY, "yyyy-MM-dd") == day).collect()
    cur_day = cur.where(F.date_format("ts", "yyyy-MM-dd") == day)
    batch = D.data_drift(ref, cur_day, W.FEATURES).tests.collect()
    a = {(r.feature, r.test): (r.statistic, r.p_value) for r in win}
    b = {(r.feature, r.test): (r.statistic, r.p_value) for r in batch}
    assert a.keys() == b.keys()
    for k in a:
        for x, y in zip(a[k], b[k]):
            assert (x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-12), k


def test_sustained_drift_and_runs(spark):
    rows = [(i, min(0.5, i / 10) > 0.3, min(0.5, i / 10), i >= 8) for i in range(10)]
    df = spark.createDataFrame(rows, "window_start int, drift_detected boolean, drift_ratio double, model_drift_detected boolean")
    s = {r.window_start: r.sustained for r in T.sustained_drift(df).collect()}
    # windows 4.. fire (ratio > 0.3); at window 7 four of the last six fired
    assert [s[i] for i in range(10)] == [False] * 7 + [True] * 3
    runs = T.alert_runs(df, "drift_detected", "window_start").collect()
    assert [(r.run_start, r.run_end, r.length) for r in runs] == [(4, 9, 6)]
    summ = T.run_summary(df.withColumn("n_records", F.lit(10))).collect()[0]
    assert summ.total_alerts == 6 and summ.first_alert == 4 and summ.max_drift_ratio == 0.5


def test_streaming_matches_batch(spark):
    out = W.stream_window_verdicts_events(spark, SF_CHECK).collect()
    batch = {r.window_start: r for r in W.window_verdicts_events(spark, SF_CHECK).collect()}
    assert len(out) == len(batch)
    for r in out:
        b = batch[r.window_start]
        assert (r.n_records, r.drift_count, r.drift_detected) == (b.n_records, b.drift_count, b.drift_detected)


def test_injection_is_reproducible_and_targets_types(spark):
    c = spark.read.parquet(f"{SF_CHECK}/customer.parquet")
    a = G.gaussian_drift(c, ["c_custkey"], 0.5, 42).orderBy("c_custkey").limit(50).collect()
    b = G.gaussian_drift(c.repartition(5), ["c_custkey"], 0.5, 42).orderBy("c_custkey").limit(50).collect()
    assert a == b
    assert a[0].c_name == c.orderBy("c_custkey").first().c_name
    swapped = G.category_swap(c, ["c_custkey"], 0.3, 42)
    before = c.select("c_custkey", F.col("c_mktsegment").alias("old_segment"))
    changed = swapped.join(before, "c_custkey").where(F.col("c_mktsegment") != F.col("old_segment")).count()
    n = c.count()
    assert 0.1 * n < changed < 0.3 * n  # 30% redrawn, some get their own value back


def test_drift_curves(spark):
    prof = spark.createDataFrame([("AGE (YEARS)", 40.0, 10.0), ("BMI", 20.0, 3.0)], "feature string, mean double, std double")
    p = {(r.window, r.feature): r.mean for r in G.drift_parameters(prof, "gradual_age_shift", 10).collect()}
    assert p[(5, "AGE (YEARS)")] == pytest.approx(40.0 * (1 + 0.4 * 0.5))
    assert p[(5, "BMI")] == pytest.approx(20.0 * (1 - 0.3 * 0.5))
    step = {(r.window, r.feature): r.mean for r in G.drift_parameters(prof.where("feature = 'BMI'").withColumn(
        "feature", F.lit("TEMPERATURE_CELCIUS")), "measurement_bias", 10).collect()}
    assert step[(4, "TEMPERATURE_CELCIUS")] == 20.0 and step[(5, "TEMPERATURE_CELCIUS")] == 25.0
