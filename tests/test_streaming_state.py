"""State of the streaming jobs: expiry, late rows, replays, bytes per batch."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnguard.operators import drift, review
from txnguard.streaming import jobs

HOUR = 3600


def _land(spark, path, rows):
    df = spark.createDataFrame(rows, "txn_id long, device_id long, t long").withColumn("et", F.timestamp_seconds("t"))
    df.coalesce(1).write.mode("append").parquet(path)
    return df.schema


def _run(spark, path, schema, out):
    v = jobs.stateful_velocity(jobs.read_stream(spark, path, schema), delay="10 minutes")
    jobs.run_available(v.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    return {r.txn_id: (r.txn_count_5m, r.txn_count_30m, r.txn_count_60m) for r in spark.read.parquet(out + "/data").collect()}


def _twin(batches):
    """Counts of what has come so far, in (t, id) order."""
    seen, out = [], {}
    for batch in batches:
        seen += batch
        for i, d, t in batch:
            out[i] = tuple(sum(1 for j, e, u in seen if e == d and t - s <= u and (u, j) <= (t, i)) for s in jobs.WINDOWS_S)
    return out


def test_velocity_state_expires_and_takes_late_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    day = 20 * 86_400
    first = [(i, int(rng.integers(0, 3)) * int(i % 3 > 0), day + int(rng.integers(0, 9 * HOUR))) for i in range(150)]  # device 0 is hot
    top = max(t for _, _, t in first)
    late = [(1000 + i, i % 3, top - 300 + 7 * i) for i in range(60)]  # behind others, not behind the watermark
    far = [(5000, 1, day + 40 * HOUR)]
    end = [(5001, 2, day + 80 * HOUR)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (first, late):
        schema = _land(spark, path, batch)
    assert _run(spark, path, schema, out) == _twin([first, late])
    held = spark.read.format("statestore").load(out + "/chk").count()
    assert held >= 3
    for batch in (far, end):  # the watermark passes all of the first day
        _land(spark, path, batch)
        got = _run(spark, path, schema, out)
    assert got == _twin([first, late, far, end])
    left = spark.read.format("statestore").load(out + "/chk").select("key.device_id", "key.chunk").collect()
    assert {(r.device_id, r.chunk) for r in left} <= {(1, (day + 40 * HOUR) // (4 * HOUR)), (2, (day + 80 * HOUR) // (4 * HOUR))}


def test_velocity_of_devices_that_share_a_bucket(spark, tmp_path):
    """One group for many devices: a group per device took most of the time."""
    rng = np.random.default_rng(3)
    day = 20 * 86_400
    first = [(i, [None, -1, 7, 0, *range(50, 150)][int(rng.integers(0, 104)) if i % 3 else i % 4], day + int(rng.integers(0, 9 * HOUR))) for i in range(400)]
    top = max(t for _, _, t in first)
    late = [(1000 + i, [7, None, 60][i % 3], top - 300 + 7 * i) for i in range(60)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in (first, late):
        schema = _land(spark, path, batch)
    v = jobs.stateful_velocity(jobs.read_stream(spark, path, schema), delay="10 minutes", buckets=2)
    jobs.run_available(v.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    got = spark.read.parquet(out + "/data").collect()
    assert {r.txn_id: (r.txn_count_5m, r.txn_count_30m, r.txn_count_60m) for r in got} == _twin([first, late])
    keys = spark.read.format("statestore").load(out + "/chk").select("key.bucket", "key.chunk").distinct().count()
    assert keys <= 3 * 4  # two buckets and the null device, by chunk
    device = {i: d for i, d, _ in first + late}
    assert len(got) == 460 and all(r.device_id == device[r.txn_id] for r in got)


def test_velocity_of_rows_without_a_time(spark, tmp_path):
    """As the SQL has it, also where devices share a bucket."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = _land(spark, path, [(1, 7, None), (2, 8, None), (3, 7, None), (4, None, None), (5, 7, None), (6, 7, 20 * 86_400), (7, None, 20 * 86_400)])
    v = jobs.stateful_velocity(jobs.read_stream(spark, path, schema), delay="10 minutes", buckets=1)
    jobs.run_available(v.writeStream.format("parquet").option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    got = {r.txn_id: r.txn_count_60m for r in spark.read.parquet(out + "/data").collect()}
    assert got == {1: -2, 3: -1, 5: 0, 2: 0, 4: 0, 6: 1, 7: 1}


def test_buckets_grow_with_the_rows(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert jobs.device_buckets(spark, 10) == 2 * n
    assert jobs.device_buckets(spark, 100_000_000) == max(2 * n, 1000)


def test_velocity_state_is_bounded_in_time(spark, tmp_path):
    """Rows that no later row can count leave the state while their chunk goes on."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    day = 20 * 86_400
    for k in range(3):
        schema = _land(spark, path, [(100 * k + i, 7, day + 6000 * k + i) for i in range(50)])
    _run(spark, path, schema, out)
    state = spark.read.format("statestore").load(out + "/chk").select(F.size("value.groupState.ts").alias("n")).collect()
    assert max(r.n for r in state) <= 100


EVENTS = "review_id string, event_seq long, ts long, event_type string, analyst string, decision string, notes string, score_xgb double, ae_error double, ae_bucket string, shap_path string"


def _events(n, k):
    return [(f"r{i}", 10 * k + j, 1000 * k + j, kind, f"a{k}", "BLOCK" if kind == "closed" else None, None, 0.1 * k, 0.2, "ok", None)
            for i in n for j, kind in enumerate(("opened", "assigned", "rescored") if k == 0 else ("assigned", "closed"))]


@pytest.fixture
def batches(spark):
    parts = [_events(range(40), 0), _events([3], 1), _events([], 2), _events([3, 4, 5], 3), _events(range(0, 40, 9), 4)]
    return [spark.createDataFrame(p, EVENTS) for p in parts]


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _size(path):
    return {os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_bucketed_state_writes_only_touched_buckets(spark, tmp_path, batches):
    state = jobs.BucketedState(spark, str(tmp_path), "review_id", review.fold_review_state, buckets=16)
    union = None
    for i, b in enumerate(batches):
        union = b if union is None else union.unionByName(b)
        before = _size(tmp_path / "state")
        touched = state.apply(b, i)
        written = {f.split("bucket=")[1].split("/")[0] for f in _size(tmp_path / "state") - before}
        assert written == {str(x) for x in touched}
        assert _rows(state.read(i)) == _rows(review.fold_review_state(union))
    assert len(state.apply(batches[1], 1)) == 1 and state.apply(batches[2], 2) == []


def test_replayed_batches_give_the_same_state(spark, tmp_path, batches):
    once = jobs.BucketedState(spark, str(tmp_path / "a"), "review_id", review.fold_review_state, buckets=8)
    again = jobs.BucketedState(spark, str(tmp_path / "b"), "review_id", review.fold_review_state, buckets=8)
    for i, b in enumerate(batches):
        once.apply(b, i)
        again.apply(b, i)
        again.apply(b, i)  # a lost driver repeats the batch
    again.apply(batches[3], 3)
    again.apply(batches[4], 4)
    for i in range(len(batches)):
        assert _rows(again.read(i)) == _rows(once.read(i))
        assert again.manifest(i) == once.manifest(i)


def test_drift_monitor_equals_reports_on_the_rows(spark, tmp_path):
    rng = np.random.default_rng(6)

    def part(n, shift, cats):
        return spark.createDataFrame([(float(rng.normal() + shift), str(rng.choice(cats)), 1 if i % 90 else None, float("nan") if i % 7 == 0 else 3.0)
                                      for i in range(n)], "x double, c string, flat int, holes double")
    features = ["x", "c", "flat", "holes"]
    base = part(600, 0, ["a", "b", "c"])
    parts = [part(200, 0, ["a", "b"]), part(300, 1.5, ["b", "d"]), part(30, 0, ["a"])]
    monitor = jobs.DriftMonitor(spark, str(tmp_path), features)
    monitor.fit(base)

    def near(got, want):
        got, want = ({r.feature: (r.psi, r.is_numeric, r.status) for r in d.collect()} for d in (got, want))
        assert got.keys() == want.keys()
        for f in want:
            assert got[f][1:] == want[f][1:]
            assert got[f][0] == want[f][0] or abs(got[f][0] - want[f][0]) < 1e-9
    union = None
    for i, p in enumerate(parts):
        monitor.apply(p, i)
        monitor.apply(p, i)  # replayed
        near(monitor.report(i), drift.psi_report(base, p, features))
        union = p if union is None else union.unionByName(p)
    near(monitor.report(total=True), drift.psi_report(base, union, features))
    assert monitor.report().count() == 3 * len(features)


@pytest.mark.parametrize("name", ["stream_velocity_window", "stream_velocity_windows"])
def test_sliding_windows_are_made_of_dealt_rows(spark, monkeypatch, name):
    """A batch is one file: its rows are dealt before each goes to its windows, and none is lost."""
    import __spark_entry__ as E
    plans = []
    run = jobs.run_available

    def running(writer):
        plans.append(writer._df._jdf.queryExecution().analyzed().toString())
        run(writer)
    monkeypatch.setattr(jobs, "run_available", running)
    assert E.queries()[name](spark, "/root/testdata/sf0.001").agg(F.sum("n")).first()[0] > 0
    for plan in plans:  # the scan is below the dealing, the windows above
        assert -1 < plan.index("Expand" if "Expand" in plan else "Aggregate") < plan.index("RepartitionByExpression")


def test_dealt_rows_per_task(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = spark.range(1000).select((F.col("id") % 5).alias("device_id"), "id")
    assert jobs.deal(df, ["device_id", "id"], 10).rdd.getNumPartitions() == n
    many = jobs.deal(df, ["device_id", "id"], 1000, rows_per_task=1000 // (n + 7))
    assert many.rdd.getNumPartitions() > n and many.count() == 1000
