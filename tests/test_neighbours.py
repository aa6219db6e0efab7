"""Exact neighbours against all distances, and oversampling with blocks far below the class."""

import numpy as np
import pytest

from tests.conftest import SF_CHECK
from tidewatch.operators.neighbours import nearest
from tidewatch.operators.smote import synthetic_rows


def brute(points, k):
    out = {}
    for p, x in points.items():
        far = sorted((sum((a - b) ** 2 for a, b in zip(x, y)), q) for q, y in points.items() if q != p)
        out[p] = [q for _, q in far[:k]]
    return out


@pytest.mark.parametrize("k, block, pivots", [(5, 16, 4), (1, 7, 1), (3, 4096, 64)])
def test_neighbours_equal_all_distances(spark, k, block, pivots):
    """Clusters, ties on a grid, many equal vectors (a third of all), several blocks and cells."""
    rnd = np.random.default_rng(3)
    rows = [tuple(map(float, v)) for v in rnd.integers(0, 4, (60, 3))]
    rows += [tuple(map(float, v)) for v in rnd.normal(rnd.integers(0, 3, (60, 1)) * 50, 1, (60, 3))]
    rows += [(1.0, 1.0, 1.0)] * 60
    points = dict(enumerate(rows))
    df = spark.createDataFrame([(p, list(x)) for p, x in points.items()], "pos long, x array<double>").repartition(5)
    got = {r.pos: r.neighbours for r in nearest(df, k, block, pivots).collect()}
    assert got == brute(points, k)


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [2.0]), (2, [2.0])], "pos long, x array<double>")
    assert {r.pos: r.neighbours for r in nearest(df, 5).collect()} == {0: [1, 2], 1: [2, 0], 2: [1, 0]}
    assert nearest(df.where("pos = 1"), 5).first().neighbours == []
    assert nearest(df.where("false"), 5).count() == 0


def test_oversampling_does_not_depend_on_the_block(spark):
    train = spark.read.parquet(f"{SF_CHECK}/embeddings.parquet").selectExpr("vec_id", "cast(label % 3 = 0 as int) as label", "cast(embedding as array<double>) as x")
    rows = {b: sorted((r.synthetic_id, r.base.vec_id, r.neighbour.vec_id) for r in synthetic_rows(train, "label", ["vec_id"], "x", block=b).collect())
            for b in (8, 4096)}
    assert len(rows[8]) > 50 and rows[8] == rows[4096]
