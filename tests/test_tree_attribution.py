import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tidewatch.operators import tree_attribution as T
from tidewatch.operators.tree_attribution import _expect, ensemble_value, leaf_shares, node_tables, patterns, shapley_batch, tree_attribution
from tidewatch.plans.model_plans import embeddings_frame


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_tree_attribution_adds_up(spark, kind):
    df = embeddings_frame(spark, SF_SMALL).withColumn("label", F.col("label").cast("double"))
    est = (RandomForestClassifier(numTrees=10, maxDepth=3, seed=1) if kind == "rf"
           else GBTClassifier(maxIter=5, maxDepth=3, seed=1))
    m = est.fit(df)
    phi, base = tree_attribution(df, m, ["vec_id"], [f"d{i}" for i in range(64)], kind)
    total = phi.groupBy("vec_id").agg(F.sum("phi").alias("s"))
    scored = m.transform(df)
    # forest: probability of class 1; boosted trees: rawPrediction = (-margin, margin)
    target = vector_to_array("probability")[1] if kind == "rf" else vector_to_array("rawPrediction")[1]
    got = scored.select("vec_id", target.alias("y")).join(total, "vec_id", "left").collect()
    b = base.collect()[0].base_value
    ys = np.array([r.y for r in got])
    ss = np.array([(r.s or 0.0) for r in got])
    if kind == "gbt":
        # Spark's logistic GBT: probability = 1 / (1 + exp(-2 margin)), so the log-odds are 2 * margin
        ys = 2.0 * ys
    assert np.allclose(ss + b, ys, atol=1e-9)


def _enumerated(tree, x, value_of):
    """Shapley values from all subsets of a tree's features; value_of(subset) is the expected output."""
    used = sorted({int(f) for f in tree["feature"] if f >= 0})
    cache = {s: value_of(frozenset(s)) for r in range(len(used) + 1) for s in combinations(used, r)}
    out = {}
    for j in used:
        rest = [u for u in used if u != j]
        out[j] = sum(math.factorial(r) * math.factorial(len(used) - r - 1) / math.factorial(len(used))
                     * (cache[tuple(sorted((*s, j)))] - cache[s]) for r in range(len(used)) for s in combinations(rest, r))
    return out


def _random_tree(rng, depth, n_features):
    tree = {k: [] for k in ("feature", "threshold", "left", "right", "cover", "value")}

    def grow(level, cover):
        i = len(tree["feature"])
        for k, v in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("cover", cover), ("value", rng.normal())):
            tree[k].append(v)
        if level < depth and rng.random() < 0.9:
            tree["feature"][i], tree["threshold"][i] = int(rng.integers(n_features)), float(rng.normal())
            part = rng.uniform(0.1, 0.9)
            tree["left"][i] = grow(level + 1, cover * part)
            tree["right"][i] = grow(level + 1, cover * (1 - part))
        return i
    grow(0, 100.0)
    return {k: np.array(v) for k, v in tree.items()} | {"weight": 1.0}


@pytest.mark.parametrize("seed", range(6))
def test_leaf_polynomials_equal_subset_enumeration(seed):
    rng = np.random.default_rng(seed)
    tree = _random_tree(rng, 5, 6)
    x, back = rng.normal(size=(20, 6)), rng.normal(size=(7, 6))
    x[0, 2] = np.nan
    got, wanted = shapley_batch([tree], x), _enumerated(tree, x, lambda s: _expect(tree, x, s))
    assert got.keys() == wanted.keys()
    for j in wanted:
        assert np.allclose(got[j], wanted[j], atol=1e-12)

    def mixed(s):
        total = np.zeros(len(x))
        for b in back:
            rows = np.tile(b, (len(x), 1))
            rows[:, list(s)] = x[:, list(s)]
            total += ensemble_value([tree], rows)
        return total / len(back)
    got, wanted = shapley_batch([tree], x, back), _enumerated(tree, x, mixed)
    for j in wanted:
        assert np.allclose(got[j], wanted[j], atol=1e-12)


def test_deep_trees_and_backgrounds_add_up(spark):
    df = embeddings_frame(spark, SF_SMALL).withColumn("label", F.col("label").cast("double"))
    m = RandomForestClassifier(numTrees=4, maxDepth=8, minInstancesPerNode=1, seed=1).fit(df)
    trees, _ = node_tables(m, "rf")
    phi, base = tree_attribution(df, m, ["vec_id"], [f"d{i}" for i in range(64)], "rf", background=df, max_background=20)
    total = phi.groupBy("vec_id").agg(F.sum("phi").alias("s"))
    got = m.transform(df).select("vec_id", vector_to_array("probability")[1].alias("y")).join(total, "vec_id", "left").collect()
    assert np.allclose([(r.s or 0.0) + base.first().base_value for r in got], [r.y for r in got], atol=1e-9)


@pytest.mark.parametrize("background", [False, True])
def test_shares_are_worked_out_by_pattern_not_by_row(background, monkeypatch):
    rng = np.random.default_rng(3)
    tree = _random_tree(rng, 3, 6)
    x, back = rng.normal(size=(5000, 6)), rng.normal(size=(100, 6))
    worked = []
    monkeypatch.setattr(T, "leaf_shares", lambda o, z: worked.append(np.broadcast_arrays(o, z)[0].size) or leaf_shares(o, z))
    got = shapley_batch([tree], x, back if background else None)
    # at most 8 patterns of three features, of rows and of background rows
    assert worked and max(worked) <= 8 * 8 * 3
    explained = ensemble_value([tree], back).mean() if background else _expect(tree, x[:1], frozenset())[0]
    assert np.allclose(sum(got.values()) + explained, ensemble_value([tree], x), atol=1e-9)


@pytest.mark.parametrize("features", [1, 3, 20])
def test_patterns_are_the_distinct_rows(features):
    rows = (np.random.default_rng(1).random((200, features)) < 0.5).astype(float)
    rows = np.concatenate([rows, rows[:50]])
    found, at = patterns(rows)
    assert (found[at] == rows).all() and len(found) == len({tuple(r) for r in rows})
