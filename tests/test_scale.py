"""Distributed rank helpers equal their single-task / NumPy twins."""

from __future__ import annotations

import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001, SF01
from txnguard.plans.scale import exact_quantiles, global_cumsum, global_row_number, percentile_rank
from txnguard.sources.tables import read_table, txn


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_global_row_number_matches_sort(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    o = read_table(spark, SF01, "orders").select("o_orderkey", "o_orderdate")
    got = global_row_number(o, ["o_orderdate", "o_orderkey"], "rn").toPandas().sort_values("rn")
    exp = o.toPandas().sort_values(["o_orderdate", "o_orderkey"]).reset_index(drop=True)
    assert list(got["o_orderkey"]) == list(exp["o_orderkey"])
    assert list(got["rn"]) == list(range(1, len(exp) + 1))
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_global_cumsum_grouped(spark):
    t = txn(spark, SF001).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("c"))
    got = global_cumsum(t, ["event_type", "k"], ["c"], group_col="event_type").toPandas()
    pdf = t.toPandas().sort_values(["event_type", "k"])
    pdf["exp"] = pdf.groupby("event_type")["c"].cumsum()
    m = got.merge(pdf, on=["event_type", "k"])
    assert (m["cum_c"] == m["exp"]).all()


def test_exact_quantiles_linear_matches_numpy(spark):
    t = txn(spark, SF001)
    probs = [0.0, 0.001, 0.25, 0.5, 0.95, 0.995, 1.0]
    got = exact_quantiles(t, "amount", probs, ["label"]).toPandas()
    pdf = t.select("amount", "label").toPandas()
    for lab, g in pdf.groupby("label"):
        for p in probs:
            q = got[(got["label"] == lab) & (np.isclose(got["p"], p))]["q"].iloc[0]
            assert q == pytest.approx(np.quantile(g["amount"].to_numpy(), p), rel=1e-12, abs=1e-12)


def test_exact_quantiles_exclusive_matches_statistics(spark):
    t = txn(spark, SF001)
    got = exact_quantiles(t, "amount", [i / 100 for i in range(1, 100)], method="exclusive").toPandas()
    data = sorted(t.select("amount").toPandas()["amount"])
    exp = statistics.quantiles(data, n=100, method="exclusive")
    got = got.sort_values("p")["q"].to_numpy()
    assert np.allclose(got, exp, rtol=0, atol=1e-9)


def test_percentile_rank_pinned_values(spark):
    base = spark.createDataFrame([(0.1,), (0.2,), (0.3,), (0.4,)], "e double")
    vals = spark.createDataFrame([(1, 0.2), (2, 0.05), (3, 0.4)], "id int, v double")
    r = {row["id"]: row["pct"] for row in percentile_rank(vals, "v", base, "e", "pct").collect()}
    assert r == {1: 50.0, 2: 0.0, 3: 100.0}


def test_percentile_rank_empty_baseline_is_null(spark):
    base = spark.createDataFrame([], "e double")
    vals = spark.createDataFrame([(1, 0.2)], "id int, v double")
    assert percentile_rank(vals, "v", base, "e", "pct").collect()[0]["pct"] is None


def test_chunked_windows_equal_plain_windows(spark):
    """Chunked (hot-device safe) windows equal the per-device windows, also
    with tiny chunks and one device holding about a third of the rows."""
    from txnguard.operators import windows as W
    t = txn(spark, SF001).select("txn_id", "device_id", "t", "amount")
    # make device 0 hot: every third row moves onto it
    t = t.withColumn("device_id", F.when(F.pmod("txn_id", F.lit(3)) == 0, F.lit(0)).otherwise(F.col("device_id")))
    ref = t.select("txn_id", *W.velocity_inclusive_cols(), W.rolling_mean_rows(), W.zscore_device()).toPandas()
    ref = ref.set_index("txn_id").sort_index()
    v = W.velocity_chunked(t, chunk_len=3601).toPandas().set_index("txn_id").sort_index()
    r = W.rolling_mean_chunked(t, chunk_rows=60).toPandas().set_index("txn_id").sort_index()
    z = W.zscore_device_agg(t).toPandas().set_index("txn_id").sort_index()
    for c in ("txn_count_5m", "txn_count_30m", "txn_count_60m"):
        assert (v[c] == ref[c]).all()
    assert (r["avg_amount_50"] == ref["avg_amount_50"]).all()
    assert (z["amount_zscore"] == ref["amount_zscore"]).all()


def test_first_per_key_and_top_k(spark):
    from txnguard.plans.scale import first_per_key, top_k_per_group
    t = txn(spark, SF001).select("txn_id", "device_id", "t", "event_type")
    got = {r["device_id"]: r["txn_id"] for r in first_per_key(t, ["device_id"], ["t", "txn_id"]).collect()}
    pdf = t.toPandas().sort_values(["device_id", "t", "txn_id"])
    exp = pdf.groupby("device_id")["txn_id"].first().to_dict()
    assert got == exp
    top = top_k_per_group(t, ["event_type"], [F.col("t").desc(), F.col("txn_id")], 3, tie_col="txn_id", buckets=4)
    got = sorted((r["event_type"], r["rank"], r["txn_id"]) for r in top.collect())
    exp = []
    for et, g in pdf.sort_values(["t", "txn_id"], ascending=[False, True]).groupby("event_type", sort=True):
        exp += [(et, i + 1, int(x)) for i, x in enumerate(g["txn_id"].head(3))]
    assert got == sorted(exp)
