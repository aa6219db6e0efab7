"""Mergeable profiles: merged windows against one pass and against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import sketches as S


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(11)
    n = 20_000
    values = np.where(rnd.random(n) < 0.3, 1e6, rnd.normal(1e6, 3.0, n)).round(3)  # a hot value, far from 0
    rows = [(int(w) if w < 5 else None, float(v), i % 977) for i, (w, v) in enumerate(zip(rnd.integers(0, 6, n), values))]
    return spark.createDataFrame(rows, "`week no` int, `x.y` double, m int").cache(), values


def test_merged_windows_equal_one_pass(spark, frame):
    df, values = frame
    parts = S.sketch_profile(df, ["x.y", "m"], by=["week no"])
    assert parts.count() == 12  # a null window is a window
    merged = {r.feature: r for r in S.read_profile(S.merge_profiles(parts)).collect()}
    x = merged["x.y"]
    assert (x.n, x.min, x.max) == (len(values), values.min(), values.max())
    assert x.mean == pytest.approx(values.mean(), rel=1e-12) and x.std == pytest.approx(values.std(ddof=1), rel=1e-6)
    for p, q in zip((0.25, 0.5, 0.75), x.q):
        assert (values < q).mean() - S.rank_bound() <= p <= (values <= q).mean() + S.rank_bound()
    assert abs(x.n_distinct - len(set(values))) <= S.distinct_bound() * len(set(values))
    assert abs(merged["m"].n_distinct - 977) <= S.distinct_bound() * 977
    by_week = {(r["week no"], r.feature): r.n for r in S.merge_profiles(parts, ["week no"]).collect()}
    exact = {r["week no"]: r["count"] for r in df.groupBy("week no").count().collect()}
    assert {w: n for (w, f), n in by_week.items() if f == "m"} == exact


def test_nulls_nan_zeros_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 0.0, "a"), (float("nan"), -0.0, "a"), (2.0, 0.0, "a")], "a double, b double, t string")
    got = {r.feature: r for r in S.read_profile(S.sketch_profile(df)).collect()}
    assert set(got) == {"a", "b"} and (got["a"].n, got["b"].n, got["b"].n_distinct) == (1, 3, 1)
    assert got["a"].std is None and got["b"].std == 0.0 and got["a"].q == [2.0, 2.0, 2.0]
    none = S.sketch_profile(df.where("t = 'b'"))
    assert none.collect() == [] and S.read_profile(S.merge_profiles(none)).collect() == []


def test_bounds_shrink_with_larger_sketches():
    assert S.rank_bound(200) > S.rank_bound(800) and S.distinct_bound(10) > S.distinct_bound(14)
