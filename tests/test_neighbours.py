"""The metric index against brute force, and SMOTE on it."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from txnguard.operators import ml, neighbours

COLS = "id long, x array<double>"


def brute(ids, x, k):
    out = {}
    for i, q in zip(ids, x):
        d = np.sqrt(((x - q) ** 2).sum(axis=1))
        out[i] = [(d[j], ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def result(df):
    return {r.id: [(n.d, n.id) for n in r.neighbours] for r in df.collect()}


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, and a third of the rows at one place."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 3)) * 0.3 + rng.integers(0, 4, (300, 1)) * 5, np.full((150, 3), 2.5)])
    ids = rng.permutation(100_000)[: len(x)]
    return ids, x, spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], COLS)


@pytest.mark.parametrize("shape", [(1, 10**6), (7, 40), (40, 10), (500, 16)])
def test_equals_brute_force(points, shape):
    ids, x, df = points
    got = result(neighbours.knn(df, "id", "x", 5, pivots=shape[0], block_rows=shape[1]))
    want = brute(ids, x, 5)
    assert got.keys() == want.keys()
    for i in got:
        assert [n for _, n in got[i]] == [n for _, n in want[i]]
        assert np.allclose([d for d, _ in got[i]], [d for d, _ in want[i]], atol=1e-12)


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [3.0]), (3, [1.0])], COLS)
    assert result(neighbours.knn(df, "id", "x", 5)) == {1: [(1.0, 3), (3.0, 2)], 2: [(2.0, 3), (3.0, 1)], 3: [(1.0, 1), (2.0, 2)]}
    assert result(neighbours.knn(df.limit(1), "id", "x", 5)) == {1: []}
    assert neighbours.knn(df.limit(0), "id", "x", 5).count() == 0


def test_far_clusters_are_not_visited(spark, points):
    """Bounds keep a query from blocks that can't hold a nearer row."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(200, 2)) + 1000 * c for c in range(5)])
    a = neighbours.nearest(x[:200], np.arange(200), x, np.arange(1000), 3)
    b = neighbours.nearest(x[:200], np.arange(200), x[:200], np.arange(200), 3)
    assert a == b
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], COLS)
    got = result(neighbours.knn(df, "id", "x", 3, pivots=10, block_rows=50))
    assert all(n // 200 == i // 200 for i, ns in got.items() for _, n in ns) and len(got) == 1000


def _table(spark, points, parts):
    ids, x, df = points
    maj = spark.range(200_000, 201_000).select("id", F.array(*[F.lit(0.0)] * 3).alias("x"), F.lit(0).alias("y"))
    return df.withColumn("y", F.lit(1)).unionByName(maj).withColumn("f", array_to_vector("x")).drop("x").repartition(parts)


def test_smote_is_balanced_and_the_same_for_any_partitioning(spark, points):
    ids, x, _ = points
    want = brute(ids, x, 5)
    place = dict(zip(ids.tolist(), x))
    seen = []
    for parts in (1, 4, 16):
        s = ml.smote(_table(spark, points, parts), "f", "y", "id", k=5)
        rows = s.where("synthetic").select("id", "syn_idx", vector_to_array("f").alias("x"), "y").collect()
        seen.append(sorted((r.id, r.syn_idx, tuple(r.x), r.y) for r in rows))
        assert s.where("y = 1").count() == s.where("y = 0").count() == 1000
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 550
    per = {}
    for i, j, p, _ in seen[0]:
        per.setdefault(i, []).append(j)
        base = place[i]
        on = [np.linalg.norm(np.cross(place[n] - base, np.asarray(p) - base)) < 1e-9 * (1 + np.linalg.norm(place[n] - base)) and
              -1e-12 <= (np.asarray(p) - base) @ (place[n] - base) <= np.sum((place[n] - base) ** 2) + 1e-12 for _, n in want[i]]
        assert any(on)
    order = sorted(per, key=int)
    assert sorted(map(len, per.values())) == [1] * 350 + [2] * 100 and all(len(per[i]) == 2 for i in order[:100])


def test_smote_without_need_or_neighbours(spark, points):
    t = _table(spark, points, 2)
    assert ml.smote(t, "f", "y", "id", minority=0).where("synthetic").count() == 0
    one = t.where("y = 0").unionByName(t.where("y = 1").limit(1))
    assert ml.smote(one, "f", "y", "id").where("synthetic").count() == 0
    assert ml.smote(t.limit(0), "f", "y", "id").count() == 0


def test_rows_are_routed_in_bounded_pieces(monkeypatch):
    """Rows that must visit all blocks aren't held with all their copies at once."""
    monkeypatch.setattr(neighbours, "ROUTED", 64)
    rng = np.random.default_rng(1)
    pivots = rng.normal(size=(90, 4))
    names = np.arange(90) << 40
    rows = pd.DataFrame({"id": np.arange(50), "x": list(rng.normal(size=(50, 4))), "block": names[:50], "within": [np.inf] * 50})
    parts = list(neighbours.visits(rows, pivots, names, np.arange(90), np.tile([0.0, 9.0], (90, 1))))
    assert max(map(len, parts)) <= 64
    got = pd.concat(parts)
    assert sorted(zip(got["id"], got["block"])) == [(i, b) for i in range(50) for b in names.tolist() if b != names[i]]
    assert list(neighbours.visits(rows[:0], pivots, names, np.arange(90), np.zeros((90, 2)))) == []


def test_small_tables_have_few_cells(spark, monkeypatch):
    seen = []
    held = spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: seen.append(v) or held(v))
    df = spark.range(3000).select("id", F.array((F.col("id") * 37 % 3000).cast("double")).alias("x"))
    assert neighbours.knn(df, "id", "x", 2).count() == 3000
    assert seen[0].shape == (2, 1)
