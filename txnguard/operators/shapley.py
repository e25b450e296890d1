"""Exact Shapley values of boosted trees against a background set.

For a row x and a background row z, a leaf is reached by a set S of features
taken from x (the others from z) exactly if S holds every feature of the leaf's
path that only x meets, and none that only z meets.  So the leaf's part in
the Shapley values depends on the two counts alone: with a features that only
x meets and b that only z meets, each of the former gets
``v (a-1)! b! / (a+b)!`` and each of the latter ``-v a! (b-1)! / (a+b)!``.

Which features of its path a row meets is one bit mask per leaf.  The background
is counted by mask once per leaf, so a row costs one lookup per leaf whatever
the number of background rows, and the result is the exact mean over them: the
values of a row add up to its margin less the background's mean margin.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnguard.session import ensure_checkpoint_dir


class Leaf(NamedTuple):
    value: float          # prediction times the tree's weight
    features: np.ndarray  # distinct features of the path
    low: np.ndarray       # a row meets feature i if low < x <= high
    high: np.ndarray


def leaves_of(model, spark) -> list[Leaf]:
    """Leaves of a fitted boosted-tree model with numeric splits, read from its
    saved node table (as large as the model)."""
    path = f"{ensure_checkpoint_dir(spark)}/trees-{uuid.uuid4().hex}"
    model.write().save(path)
    rows = spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect()
    weights = list(model.treeWeights)
    trees: dict[int, dict] = {}
    for r in rows:
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    out = []
    for tree, nodes in sorted(trees.items()):
        todo = [(0, {})]
        while todo:
            at, box = todo.pop()
            node = nodes[at]
            if node["leftChild"] < 0:
                f = sorted(box)
                out.append(Leaf(node["prediction"] * weights[tree], np.array(f, np.int64),
                                np.array([box[i][0] for i in f]), np.array([box[i][1] for i in f])))
                continue
            split = node["split"]
            if split["numCategories"] != -1:
                raise ValueError("only numeric splits are explained")
            i, cut = split["featureIndex"], split["leftCategoriesOrThreshold"][0]
            lo, hi = box.get(i, (-np.inf, np.inf))
            todo.append((node["leftChild"], box | {i: (lo, min(hi, cut))}))
            todo.append((node["rightChild"], box | {i: (max(lo, cut), hi)}))
    return out


def masks(leaf: Leaf, x: np.ndarray) -> np.ndarray:
    """Per row the bits of the leaf's features that it meets."""
    part = x[:, leaf.features]
    return ((part > leaf.low) & (part <= leaf.high)) @ (1 << np.arange(len(leaf.features)))


def margin(leaves: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    return sum((leaf.value * (masks(leaf, x) == (1 << len(leaf.features)) - 1) for leaf in leaves), np.zeros(len(x)))


def leaf_table(leaf: Leaf, background: np.ndarray) -> np.ndarray:
    """Shapley parts by (mask of x, feature of the path), a mean over the background."""
    m = len(leaf.features)
    size, bits = 1 << m, np.arange(m)
    count = np.bincount(masks(leaf, background), minlength=size) / len(background)
    z = np.flatnonzero(count)
    x = np.arange(size)
    met = (x[:, None] | z[None, :]) == size - 1  # by x or by z: else no set reaches the leaf
    by_x = (x[:, None] & ~z[None, :])[:, :, None] >> bits & 1
    by_z = (~x[:, None] & z[None, :])[:, :, None] >> bits & 1
    a, b = by_x.sum(2), by_z.sum(2)
    fact = np.array([factorial(i) for i in range(m + 1)], float)
    share = leaf.value * count[z][None, :] * met
    plus = share * fact[np.maximum(a - 1, 0)] * fact[b] / fact[a + b]
    minus = share * fact[a] * fact[np.maximum(b - 1, 0)] / fact[a + b]
    return (plus[:, :, None] * by_x - minus[:, :, None] * by_z).sum(1)


def values(leaves: Sequence[Leaf], x: np.ndarray, background: np.ndarray) -> np.ndarray:
    """Shapley values of the margin, rows by features."""
    out = np.zeros(x.shape)
    for leaf in leaves:
        if len(leaf.features):
            out[:, leaf.features] += leaf_table(leaf, background)[masks(leaf, x)]
    return out


def tree_shap(model, rows: DataFrame, names: Sequence[str], key: str, background: DataFrame, n_background: int = 500,
              seed: int = 42, features: str = "features") -> DataFrame:
    """``(key, feature, contribution)`` of every row of ``rows``, to the model's
    margin.  The background is the ``n_background`` rows of the smallest key hashes
    (a bounded sample, the operator's parameter); it and the trees are broadcast."""
    spark = rows.sparkSession
    few = background.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n_background)
    z = np.array([r[0] for r in few.select(vector_to_array(features)).collect()], float)  # n_background rows
    sent = spark.sparkContext.broadcast((leaves_of(model, spark), z))
    kind = rows.select(key).schema[0].dataType.simpleString()

    def run(batches):
        leaves, back = sent.value
        for b in batches:
            if len(b):
                phi = values(leaves, np.stack(b["x"].to_numpy()).astype(float), back)
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(names)), "feature": np.tile(np.array(names, object), len(b)),
                                    "contribution": phi.ravel()})
    return rows.select(key, vector_to_array(features).alias("x")).mapInPandas(run, f"{key} {kind}, feature string, contribution double")
