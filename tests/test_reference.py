"""Lookups in a prepared reference against numpy, and their plans."""

import numpy as np
import pytest

from tidewatch.operators import drift as D
from tidewatch.operators import monitor as T
from tidewatch.operators import reference as R


def counts(spark, values, feature="v"):
    return spark.createDataFrame([(feature, float(v), n) for v, n in values], "feature string, value double, n_ref long")


@pytest.mark.parametrize("block", [1, 2, 7, 4096])
def test_lookup_equals_counting(spark, block):
    rnd = np.random.default_rng(4)
    values = [(v, int(n)) for v, n in zip(range(-50, 150, 2), rnd.integers(1, 9, 100))]
    ref = counts(spark, values).union(counts(spark, [(0.5, 3), (1.5, 1), (9.0, 2)], "w"))
    prepared = R.prepare(ref, spark.createDataFrame([], "feature string, category string, n_ref long"), 10, 1e-6, block=block)
    asked = [-100.0, -50.0, -49.5, 0.0, 1.0, 148.0, 149.0, float("inf")]
    points = spark.createDataFrame([(f, x) for f in ("v", "w", "unknown") for x in asked], "feature string, value double")
    got = {(r.feature, r.value): (r.F_in, r.F_ex, r.R) for r in R.lookup(prepared, points, block).collect()}
    assert len(got) == 2 * len(asked)
    for f, own in (("v", values), ("w", [(0.5, 3), (1.5, 1), (9.0, 2)])):
        total = sum(n for _, n in own)
        for x in asked:
            expected = (sum(n for v, n in own if v <= x) / total, sum(n for v, n in own if v < x) / total, total)
            assert got[f, x] == pytest.approx(expected), (f, x)


def test_empty_reference_has_no_tests(spark):
    none = spark.createDataFrame([], "feature string, value double, n_ref long")
    prepared = R.prepare(none, spark.createDataFrame([], "feature string, category string, n_ref long"), 10, 1e-6)
    cur = spark.createDataFrame([("d", "v", 1.0, 2)], "window_start string, feature string, value double, n_cur long")
    cat = spark.createDataFrame([], "window_start string, feature string, category string, n_cur long")
    assert T.window_tests(prepared, cur, cat).count() == 0


def test_batches_do_not_sort_the_reference(spark):
    """The plan of a batch's lookups reads the reference's blocks without a sort, a window or a shuffle of them."""
    prepared = R.prepare(counts(spark, [(i, 1) for i in range(20000)]), spark.createDataFrame([], "feature string, category string, n_ref long"),
                         D.PSI_DEFAULT_BINS, D.PSI_SHARE_FLOOR)
    cur = spark.createDataFrame([("d", "v", float(i), 1) for i in range(100)], "window_start string, feature string, value double, n_cur long")
    found = R.lookup(prepared, cur.select("feature", "value").distinct())
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastHashJoin" in plan and "Sort " not in plan and "Window" not in plan and "SortMergeJoin" not in plan
