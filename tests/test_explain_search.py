"""Shapley values by brute force, the random search's folds and draws, McNemar."""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import combinations
from threading import Barrier
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from txnguard.operators import metrics, ml, shapley


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 4)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] * x[:, 2] > 0.1)).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), v.tolist()) for i, v in enumerate(x)], "id long, label int, a array<double>")
    df = df.withColumn("features", array_to_vector("a")).drop("a").cache()
    return x, df, ml.gbt_train(df, max_iter=8, max_depth=4, col_subsample="all")


def test_margin_and_additivity(spark, fitted):
    x, df, model = fitted
    leaves = shapley.leaves_of(model, spark)
    margin = shapley.margin(leaves, x)
    p = {r.id: r.p_model for r in ml.score(model, df).select("id", "p_model").collect()}
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), [p[i] for i in range(len(x))], atol=1e-12)
    back = x[:200]
    phi = shapley.values(leaves, x, back)
    assert np.abs(phi.sum(1) - (margin - shapley.margin(leaves, back).mean())).max() < 1e-9


def test_values_equal_brute_force(spark, fitted):
    x, _, model = fitted
    leaves = shapley.leaves_of(model, spark)
    back, rows, d = x[100:130], x[:12], 4
    phi = shapley.values(leaves, rows, back)
    for r, row in enumerate(rows):
        def worth(s):
            mixed = back.copy()
            mixed[:, list(s)] = row[list(s)]
            return shapley.margin(leaves, mixed).mean()
        for i in range(d):
            rest = [j for j in range(d) if j != i]
            want = sum(math.factorial(len(s)) * math.factorial(d - len(s) - 1) / math.factorial(d) * (worth((*s, i)) - worth(s))
                       for n in range(d) for s in combinations(rest, n))
            assert abs(phi[r, i] - want) < 1e-9


def test_distributed_values(spark, fitted):
    x, df, model = fitted
    got = shapley.tree_shap(model, df.where("id < 50").repartition(4), ["a", "b", "c", "d"], "id", df, n_background=60)
    rows = {(r.id, r.feature): r.contribution for r in got.collect()}
    order = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(60).collect()]
    want = shapley.values(shapley.leaves_of(model, spark), x[:50], x[order])
    assert len(rows) == 200
    assert max(abs(rows[i, f] - want[i, k]) for i in range(50) for k, f in enumerate("abcd")) < 1e-12
    imp = ml.global_importance(got, 2).collect()
    assert [r["rank"] for r in imp] == [1, 2]


def test_search_space_and_draws():
    assert ml.SEARCH_DRAWS == 30 and np.prod([len(v) for v in ml.SEARCH_GRID.values()]) == 432
    a, b = ml.draws(ml.SEARCH_GRID, 30, 42), ml.draws(ml.SEARCH_GRID, 30, 42)
    assert a == b and len({tuple(s.values()) for s in a}) == 30 and a != ml.draws(ml.SEARCH_GRID, 30, 43)
    assert len(ml.draws({"x": [1, 2], "y": [3]}, 30, 1)) == 2


def test_search_is_the_same_for_any_partitioning(fitted):
    _, df, _ = fitted
    grid = {"maxDepth": [2, 3], "stepSize": [0.1], "maxIter": [3], "subsamplingRate": [0.8], "featureSubsetStrategy": ["0.8"]}
    a = ml.random_search(df.where("id < 300").repartition(1), "id", grid=grid, n_iter=2, parts=3).collect()
    b = ml.random_search(df.where("id < 300").orderBy(F.desc("id")).repartition(7), "id", grid=grid, n_iter=2, parts=3).collect()
    assert a == b and len(a) == 2 and all(0 < r.cv_average_precision <= 1 for r in a)


def _count_scored(spark, monkeypatch):
    """Rows scored by ``ml.score`` from here on, each as often as it is."""
    n, plain = spark.sparkContext.accumulator(0), ml.score
    seen = F.udf(lambda p: n.add(1) or p, "double").asNondeterministic()
    monkeypatch.setattr(ml, "score", lambda model, df, out="p_model": plain(model, df, out).withColumn(out, seen(out)))
    return n


def test_search_scores_a_fold_once(spark, fitted, monkeypatch):
    _, df, _ = fitted
    fits, plain = [], ml.GBTClassifier.fit
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, x: fits.append(x.rdd.getNumPartitions()) or plain(self, x))
    n = _count_scored(spark, monkeypatch)
    grid = {"maxDepth": [2], "stepSize": [0.1], "maxIter": [2], "subsamplingRate": [0.8], "featureSubsetStrategy": ["0.8"]}
    ml.random_search(df.where("id < 300"), "id", grid=grid, n_iter=1, parts=2, rows_per_part=60).collect()
    assert n.value == 300
    assert fits == [5, 5, 5]  # parts grow with the rows


@pytest.mark.parametrize("name,times", [("ml_gbt_train", {"train": 1, "val": 1, "test": 1}), ("ml_retrain_with_feedback", {"test": 2})])
def test_rows_are_scored_once(spark, monkeypatch, name, times):
    """Several metrics read the scores; none scores the rows anew."""
    import __spark_entry__ as E
    from txnguard.plans import bind_ml
    monkeypatch.setattr(bind_ml, "GBT_ITER", 2)
    tables, plain = [], bind_ml.model_table
    monkeypatch.setattr(bind_ml, "model_table", lambda *a: tables.append(plain(*a)) or tables[-1])
    n = _count_scored(spark, monkeypatch)
    E.queries()[name](spark, "/root/testdata/sf0.001").collect()
    rows = {r["split"]: r["count"] for r in tables[0][0].groupBy("split").count().collect()}
    assert len(tables) == 1 and n.value == sum(rows[s] * k for s, k in times.items())


SIZES = ("maxIter", "maxDepth", "stepSize", "subsamplingRate", "featureSubsetStrategy")


@pytest.fixture
def own_table(spark, monkeypatch):
    """Queries train on these rows."""
    from txnguard.plans import bind_ml
    rng = np.random.default_rng(8)
    rows = [(i, ("train", "train", "val", "test")[i % 4], int(v[0] > 0), rng.random(), v.tolist()) for i, v in enumerate(rng.normal(size=(120, 2)))]
    x = spark.createDataFrame(rows, "txn_id long, split string, label int, p_xgb double, a array<double>")
    x = x.withColumn("features", array_to_vector("a")).drop("a")
    monkeypatch.setattr(bind_ml, "model_table", lambda *a: (x, ["a", "b"]))
    return x


def test_gbt_train_is_of_the_whole_size(spark, own_table, monkeypatch):
    from txnguard.plans import bind_ml
    sizes, plain = [], ml.GBTClassifier.fit
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, x: sizes.append(tuple(self.getOrDefault(n) for n in SIZES))
                        or plain(self.copy({self.maxIter: 1}), x))
    assert {r.split for r in bind_ml.q_gbt(spark, "").collect()} == {"train", "val", "test"}
    assert sizes == [(300, 6, 0.05, 0.8, "0.8")]


def _fits_only(monkeypatch, at_fit):
    """Fits call ``at_fit``, scores and their metric are constants."""
    monkeypatch.setattr(ml.GBTClassifier, "fit", lambda self, x: at_fit(self))
    monkeypatch.setattr(ml, "score", lambda model, df, out="p_model": df.withColumn(out, F.lit(0.5)))
    monkeypatch.setattr(metrics, "average_precision", lambda df, score, label: SimpleNamespace(first=lambda: (0.25,)))


def test_search_tries_the_whole_space(spark, own_table, monkeypatch):
    from txnguard.plans import bind_ml
    sizes = []
    _fits_only(monkeypatch, lambda gbt: sizes.append(tuple(gbt.getOrDefault(n) for n in ml.SEARCH_GRID)))
    rows = bind_ml.q_random_search(spark, "").orderBy("draw").collect()
    want = [tuple(s.values()) for s in ml.draws(ml.SEARCH_GRID, 30, 42)]
    assert [(r.max_depth, r.step, r.max_iter, r.subsample, r.col_subsample) for r in rows] == want
    assert sorted(sizes) == sorted(want * 3) and {r.cv_average_precision for r in rows} == {0.25}


def test_small_fits_run_at_once(spark, own_table, monkeypatch):
    both = Barrier(2, timeout=60)
    _fits_only(monkeypatch, lambda gbt: both.wait())
    assert len(ml.random_search(own_table, "txn_id", n_iter=2).collect()) == 2

    def fail(gbt):
        raise ValueError("no fit")
    _fits_only(monkeypatch, fail)
    with pytest.raises(ValueError, match="no fit"):
        ml.random_search(own_table, "txn_id", n_iter=2)


def test_model_vectors_are_written_once(spark):
    """Fits and scorings read vectors, they don't assemble them (the explained rows' too)."""
    from txnguard.plans import bind_ml
    x, names = bind_ml.model_table(spark, "/root/testdata/sf0.001")
    plan = x._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan and "Join" not in plan and "UDF" not in plan
    assert x.first()["features"].size == len(names)


def test_categories_are_read_in_one_pass(spark):
    n = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            n.add(len(b))
            yield b
    df = spark.createDataFrame([(f"c{i % 3}" if i % 4 else None, i % 2 == 0, None) for i in range(60)], "c string, f boolean, e string")
    assert ml.train_categories(df.mapInPandas(count, df.schema), ["c", "f", "e"]) == {"c": ["c0", "c1", "c2"], "f": ["false", "true"], "e": []}
    assert n.value == 60 and ml.train_categories(df, []) == {}


@pytest.mark.parametrize("n", [1, 2, 6, 7, 25, 2001])
def test_binomial_tail_is_exact(n):
    whole = Fraction(0)
    for k in range(n + 1):
        whole += Fraction(math.comb(n, k), 2**n)
        if n < 100 or k % 97 == 0 or abs(k - n // 2) < 3:
            assert abs(metrics.binom_cdf_half(k, n) - float(whole)) <= 1e-12 * max(float(whole), 1e-290) + 1e-15 * (2 * k >= n)
    assert metrics.binom_cdf_half(-1, n) == 0 and metrics.binom_cdf_half(n, n) == 1


def test_binomial_tail_of_two_million():
    n = 2_000_000
    for k in (1_000_000, 999_999, 999_000, 998_000, 997_000):
        i = np.arange(max(0, k - 60_000), k + 1)
        logs = np.array([math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in i]) + n * math.log(0.5)
        assert metrics.binom_cdf_half(k, n) == pytest.approx(np.exp(logs).sum(), rel=1e-6)


def _pairs(spark, n01, n10, same=5):
    rows = [(1, 1, 0)] * n01 + [(1, 0, 1)] * n10 + [(0, 0, 0)] * same
    return spark.createDataFrame(rows, "y int, a int, b int")


@pytest.mark.parametrize("n01,n10,test,statistic,direction", [
    (6, 0, "exact", 0.0, "a"), (1, 5, "exact", 1.0, "none"), (0, 9, "exact", 0.0, "b"), (0, 0, "exact", 0.0, "none"),
    (40, 15, "chi2", 24 * 24 / 55, "a"), (20, 25, "chi2", 16 / 45, "none"), (100, 200, "chi2", 99 * 99 / 300, "b")])
def test_direction(spark, n01, n10, test, statistic, direction):
    r = metrics.mcnemar_direction(_pairs(spark, n01, n10), "y", "a", "b").first()
    assert (r.n01, r.n10, r.test, r.direction) == (n01, n10, test, direction)
    assert r.statistic == pytest.approx(statistic, abs=1e-6)
    if test == "chi2":
        assert r.p_value == pytest.approx(math.erfc(math.sqrt(statistic / 2)), abs=1e-6)
