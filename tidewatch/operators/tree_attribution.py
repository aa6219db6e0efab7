"""Attribution for Spark ML tree ensembles (X2): exact Shapley values, path-dependent or against a background.

A tree is the sum of its leaves: a leaf's value counts where every feature on its
path lies in the leaf's interval. With the features in S fixed to the row's values,
a leaf contributes value * prod_{f in S} o_f * prod_{f not in S} z_f, where o_f says
whether the row is in f's interval and z_f is the share of the training cover that
takes the leaf's branches on f or, with a background, whether a background row is in the
interval. The Shapley value of f then is (o_f - z_f) * value * sum_s c_s s! (d-s-1)! / d!,
with c_s the coefficients of prod_{g != f} (z_g + o_g t) and d the features on the path.
So work grows with leaves and path lengths, not with subsets, and the attributions of a
row add up to the explained value minus the base value.

The ensemble's leaf table is extracted once on the driver (trees x leaves, a few
thousand rows at most) and shipped with the function, as is the background (at most
``max_background`` rows); rows are processed in Arrow batches by ``mapInPandas``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.features import background_sample

#: Rows (times background rows) worked on at once.
_BLOCK = 1 << 17


def node_tables(model, kind: str) -> tuple[list[dict], float]:
    """Per tree: arrays (feature, threshold, left, right, cover, value) and its weight.

    ``kind`` 'gbt' explains the log-odds (Spark's logistic GBT margin times 2),
    'rf' the probability of class 1 (trees averaged).
    """
    jm = model._java_obj
    weights = list(model.treeWeights)
    trees = []
    scale = 2.0 if kind == "gbt" else 1.0 / len(weights)
    for t_i in range(len(weights)):
        root = jm.trees()[t_i].rootNode()
        feat, thr, left, right, cover, value = [], [], [], [], [], []

        def visit(node):
            idx = len(feat)
            feat.append(-1); thr.append(0.0); left.append(-1); right.append(-1)  # noqa: E702
            cover.append(float(node.impurityStats().count()))
            if kind == "rf":
                stats = list(node.impurityStats().stats())
                value.append(stats[1] / sum(stats) if len(stats) > 1 and sum(stats) > 0 else 0.0)
            else:
                value.append(float(node.prediction()))
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                if split.getClass().getSimpleName() != "ContinuousSplit":
                    raise ValueError("categorical splits are not supported")
                feat[idx] = int(split.featureIndex())
                thr[idx] = float(split.threshold())
                left[idx] = visit(node.leftChild())
                right[idx] = visit(node.rightChild())
            return idx

        visit(root)
        trees.append({"feature": np.array(feat), "threshold": np.array(thr), "left": np.array(left),
                      "right": np.array(right), "cover": np.array(cover), "value": np.array(value),
                      "weight": float(weights[t_i]) * scale})
    base = sum(t["weight"] * _expect(t, np.zeros((1, 1)), frozenset())[0] for t in trees)
    return trees, float(base)


def _expect(tree: dict, x: np.ndarray, fixed: frozenset, node: int = 0) -> np.ndarray:
    """E[tree(x) | features in ``fixed`` known] for every row of x."""
    f = tree["feature"][node]
    if f < 0:
        return np.full(x.shape[0], tree["value"][node])
    lft, rgt = tree["left"][node], tree["right"][node]
    if f in fixed:
        go_left = x[:, f] <= tree["threshold"][node]
        out = np.empty(x.shape[0])
        if go_left.any():
            out[go_left] = _expect(tree, x[go_left], fixed, lft)
        if (~go_left).any():
            out[~go_left] = _expect(tree, x[~go_left], fixed, rgt)
        return out
    c = tree["cover"]
    total = c[lft] + c[rgt]
    if total <= 0:
        return np.full(x.shape[0], tree["value"][node])
    return (c[lft] * _expect(tree, x, fixed, lft) + c[rgt] * _expect(tree, x, fixed, rgt)) / total


def leaf_paths(tree: dict) -> list[tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(value, features, lower, upper, cover share) of every leaf; one entry per feature on its path."""
    out = []
    stack = [(0, {})]
    while stack:
        node, path = stack.pop()
        f, left, right = int(tree["feature"][node]), tree["left"][node], tree["right"][node]
        total = tree["cover"][left] + tree["cover"][right] if f >= 0 else 0.0
        if f < 0 or total <= 0:  # a node that no training row reached counts as a leaf
            out.append((tree["value"][node], np.array(list(path), np.int64), *np.array(list(path.values()), np.float64).reshape(-1, 3).T))
            continue
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        cut = tree["threshold"][node]
        stack.append((left, path | {f: (low, min(high, cut), share * tree["cover"][left] / total)}))
        stack.append((right, path | {f: (max(low, cut), high, share * tree["cover"][right] / total)}))
    return out


def inside(x: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether x takes the leaf's branches on each feature: left where x <= threshold, so NaN goes right."""
    v = x[..., features]
    return (~(v <= low) & ((v <= high) | np.isposinf(high))).astype(np.float64)


def leaf_shares(o: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Shapley values of the product game of one leaf; ``o`` and ``z`` broadcast, features on the last axis."""
    o, z = np.broadcast_arrays(o, z)
    d = o.shape[-1]
    weights = [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]
    out = np.empty(o.shape)
    for f in range(d):
        coefficients = [np.ones(o.shape[:-1])]
        for g in range(d):
            if g != f:
                with_zero, with_one = [c * z[..., g] for c in coefficients], [c * o[..., g] for c in coefficients]
                coefficients = ([with_zero[0]] + [a + b for a, b in zip(with_zero[1:], with_one[:-1], strict=True)] + [with_one[-1]])
        out[..., f] = (o[..., f] - z[..., f]) * sum(w * c for w, c in zip(weights, coefficients, strict=True))
    return out


def patterns(inside_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a 0/1 array, and which of them each row is."""
    d = inside_.shape[1]
    if d > 16:
        found, at = np.unique(inside_, axis=0, return_inverse=True)
        return found, at.reshape(-1)
    code = (inside_ @ (1 << np.arange(d))).astype(np.int64)
    have = np.bincount(code, minlength=1 << d) > 0
    found = np.flatnonzero(have)
    return (found[:, None] >> np.arange(d) & 1).astype(np.float64), (np.cumsum(have) - 1)[code]


def shapley_batch(trees: list[dict], x: np.ndarray, background: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """{feature index: phi per row} summed over the ensemble.

    A leaf sees a row only by the intervals it lies in, so a leaf's shares are worked out once for each
    distinct pattern of rows and of background rows, and looked up by row.
    """
    phi = {int(f): np.zeros(len(x)) for t in trees for f in t["feature"] if f >= 0}
    for t in trees:
        for value, features, low, high, share in leaf_paths(t):
            if not len(features) or value == 0:
                continue
            z = share
            if background is not None:
                z, of = patterns(inside(background, features, low, high))
                times = np.bincount(of, minlength=len(z)) / len(background)
            step = max(1, _BLOCK // (1 if background is None else len(z)))
            for at in range(0, len(x), step):
                o, row = patterns(inside(x[at:at + step], features, low, high))
                parts = leaf_shares(o, z) if background is None else np.einsum("b,obk->ok", times, leaf_shares(o[:, None, :], z[None, :, :]))
                for k, f in enumerate(features.tolist()):
                    phi[f][at:at + step] += (t["weight"] * value * parts[:, k])[row]
    return phi


def ensemble_value(trees: list[dict], x: np.ndarray) -> np.ndarray:
    """The explained value of every row."""
    out = np.zeros(len(x))
    for t in trees:
        for value, features, low, high, _ in leaf_paths(t):
            out += t["weight"] * value * inside(x, features, low, high).prod(axis=1)
    return out


def tree_attribution(df: DataFrame, model, keys: Sequence[str], slot_names: Sequence[str], kind: str,
                     features: str = "features", background: DataFrame | None = None,
                     max_background: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Long attributions (keys..., slot, phi) for the slots the ensemble uses,
    and a one-row (base_value) frame.

    With a ``background`` (same columns as ``df``) the base is the mean value of its rows, and
    features are replaced by those of background rows; at most ``max_background``, the first in
    hash order (I14), are used. Without one, the training cover stands for the absent features.
    """
    trees, base = node_tables(model, kind)
    against = None
    if background is not None:
        kept = background_sample(background, keys, max_background, seed).select(vector_to_array(F.col(features)).alias("_x")).collect()
        against = np.array([r["_x"] for r in kept], np.float64)
        if not len(against):
            raise ValueError("the background has no rows")
        base = float(ensemble_value(trees, against).mean())
    names = list(slot_names)
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name in keys}
    schema = ", ".join(f"`{k}` {key_types[k]}" for k in keys) + ", slot string, phi double"
    src = df.select(*keys, vector_to_array(F.col(features)).alias("_x"))

    def run(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.vstack(pdf["_x"].to_numpy())
            phi = shapley_batch(trees, x, against)
            parts = []
            for j, v in phi.items():
                part = pdf[list(keys)].copy()
                part["slot"] = names[j]
                part["phi"] = v
                parts.append(part)
            if parts:
                yield pd.concat(parts, ignore_index=True)

    spark = df.sparkSession
    return src.mapInPandas(run, schema), spark.createDataFrame([(base,)], "base_value double")
