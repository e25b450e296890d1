"""Invariants of model, resampling and streaming operators (rows-only in the
driver), checked against NumPy or their batch twins on sf0.001."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF001
from txnguard.operators import metrics, ml, robust
from txnguard.sources import io
from txnguard.sources.tables import txn


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stateful_velocity_stream_equals_batch(spark):
    q = E.queries()
    cols = ["txn_id", "txn_count_5m", "txn_count_30m", "txn_count_60m"]
    assert _rows(q["stream_velocity_stateful"](spark, SF001), cols) == _rows(q["win_velocity_inclusive"](spark, SF001), cols)


def test_stream_scoring_equals_batch_policy(spark):
    q = E.queries()
    cols = ["txn_id", "decision", "ae_bucket", "reason_codes"]
    assert _rows(q["stream_score_decisions"](spark, SF001), cols) == _rows(q["policy_api"](spark, SF001), cols)


def test_stream_review_state_equals_batch_fold(spark):
    q = E.queries()
    cols = ["review_id", "status", "analyst", "analyst_decision", "shap_path", "updated"]
    assert _rows(q["stream_review_state"](spark, SF001), cols) == _rows(q["store_review_state"](spark, SF001), cols)


def test_bootstrap_matches_numpy_row_resampling(spark):
    rng = np.random.default_rng(0)
    n = 2000
    y = rng.integers(0, 2, n)
    a = np.where(rng.random(n) < 0.8, y, 1 - y)
    b = np.where(rng.random(n) < 0.7, y, 1 - y)
    df = spark.createDataFrame([(int(i), int(u), int(v), int(w)) for i, (u, v, w) in enumerate(zip(y, a, b))],
                               "id long, y int, a int, b int")
    res = {r["metric"]: r for r in metrics.bootstrap_ci(df, "y", "a", "b", n_boot=400, seed=7).collect()}

    def f1(yy, pp):
        tp = ((yy == 1) & (pp == 1)).sum()
        p = tp / max((pp == 1).sum(), 1)
        r = tp / max((yy == 1).sum(), 1)
        return 2 * p * r / (p + r) if p + r else 0.0
    deltas = []
    for _ in range(400):
        idx = rng.integers(0, n, n)
        deltas.append(f1(y[idx], b[idx]) - f1(y[idx], a[idx]))
    # same sampling distribution: means agree within a few standard errors
    assert res["f1"]["mean_delta"] == pytest.approx(np.mean(deltas), abs=4 * np.std(deltas) / np.sqrt(400) + 1e-3)
    assert res["f1"]["ci_low"] < res["f1"]["mean_delta"] < res["f1"]["ci_high"]


def test_bootstrap_independent_of_partitioning(spark):
    df = txn(spark, SF001).select("label", (F.col("p_xgb") >= 0.5).cast("int").alias("a"),
                                  (F.col("ae_err") > 100).cast("int").alias("b"))
    r1 = sorted(metrics.bootstrap_ci(df, "label", "a", "b", n_boot=200, n_tasks=1).collect())
    r2 = sorted(metrics.bootstrap_ci(df, "label", "a", "b", n_boot=200, n_tasks=7).collect())
    assert r1 == r2


def test_smote_balances_and_interpolates(spark):
    from txnguard.plans.bind_ml import embedding_table
    e = embedding_table(spark, SF001)
    s = ml.smote(e, "features", "minority", "vec_id", minority=1, k=5, seed=42)
    counts = {r["minority"]: r["count"] for r in s.groupBy("minority").count().collect()}
    assert counts[0] == counts[1]
    # every synthetic point lies inside the minority bounding box
    mino = np.stack([np.asarray(r[0]) for r in e.where("minority = 1").select(vector_to_array("features")).collect()])
    syn = np.stack([np.asarray(r[0]) for r in s.where("synthetic").select(vector_to_array("features")).collect()])
    assert (syn >= mino.min(axis=0) - 1e-9).all() and (syn <= mino.max(axis=0) + 1e-9).all()


def test_reconstruction_error_invariants(spark):
    from txnguard.plans.bind_ml import embedding_table
    e = embedding_table(spark, SF001)
    ae = ml.anomaly_train(e.where("minority = 0"), k=8)
    r = ml.reconstruction_error(e, ae).toPandas()
    assert (r["ae_err"] >= 0).all()
    x = np.stack([np.asarray(v) for v in e.select(vector_to_array("features")).toPandas().iloc[:, 0]])
    centred = x - ae["mean"]
    assert r["ae_err"].max() <= (centred ** 2).mean(axis=1).max() + 1e-9


def test_robust_perturbation_deterministic(spark):
    t = txn(spark, SF001).select("txn_id", "p_xgb", "ae_err")
    a = robust.perturb(t, "txn_id", ["p_xgb", "ae_err"]).orderBy("txn_id", "trial").collect()
    b = robust.perturb(t.repartition(5), "txn_id", ["p_xgb", "ae_err"]).orderBy("txn_id", "trial").collect()
    assert a == b
    assert all(0.8 * r0["p_xgb"] - 1e-12 <= r1["p_xgb"] <= 1.2 * r0["p_xgb"] + 1e-12
               for r0, r1 in zip(t.orderBy("txn_id").collect(), a[::5]))


def test_reproducibility_signature_stable(spark):
    t = txn(spark, SF001).select("txn_id", "amount", "label")
    s1 = io.reproducibility_signature(t, ["txn_id"]).first()
    s2 = io.reproducibility_signature(t.repartition(3), ["txn_id"]).first()
    assert s1 == s2 and s1["n_rows"] == 200


def test_signature_covers_every_row(spark):
    t = spark.range(1000).select(F.col("id").alias("txn_id"), (F.col("id") % 7).alias("amount"))
    whole = io.whole_signature(t).first()
    late = t.withColumn("amount", F.when(F.col("txn_id") == 900, 99).otherwise(F.col("amount")))
    assert whole["n_rows"] == 1000
    assert io.whole_signature(late).first()["signature"] != whole["signature"]
    assert io.whole_signature(t.orderBy(F.desc("txn_id"))).first() == whole
    assert E.queries()["sink_reproducibility_signature"](spark, SF001).first()["n_rows"] == txn(spark, SF001).count()


def test_registry_config_with_large_ids(spark):
    from txnguard.plans import bind_review
    d = spark.createDataFrame([(250_000, 1, "old"), (1, 2, "new")], "id long, created long, model_version string")
    assert bind_review.registry_config(d).first()["active_version"] == "new"


def test_bootstrap_query_runs_every_resample(spark, monkeypatch):
    """As many resamples as the reference and the operator's default."""
    from txnguard.plans import bind_metrics
    seen = []
    monkeypatch.setattr(bind_metrics.metrics, "bootstrap_ci", lambda *a, n_boot=5000, **k: seen.append(n_boot))
    E.queries()["eval_bootstrap_ci"](spark, SF001)
    assert seen == [5000]
