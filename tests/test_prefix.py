"""Windows that split a hot key against the plain windows, with a third of all
rows (and a burst at one instant) on one key; orders over whole tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnguard.operators import windows as W
from txnguard.plans import prefix, scale

DAY = 86_400


@pytest.fixture(scope="module")
def hot(spark):
    """Device 0 holds a third of the rows, a quarter of those at one instant;
    null devices, negative times, null amounts, equal amounts in a row."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        dev = 0 if i % 3 == 0 else None if i % 50 == 1 else int(rng.integers(1, 30))
        t = 500_000 if i % 12 == 0 else int(rng.integers(-3 * DAY, 40 * DAY)) if i % 5 else int(rng.integers(0, 4000))
        amount = None if i % 71 == 0 else 5.0 if dev == 7 else float(rng.integers(0, 90_000)) / 100
        rows.append((i * 7919 % 300_007, dev, t, amount, int(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "txn_id long, device_id int, t long, amount double, k int").repartition(5).cache()


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(prefix, "TIE_BITS", 12)


def same(a, b, col):
    x, y = (dict(d.select("txn_id", col).collect()) for d in (a, b))
    assert len(x) == 3000 and x == y


def test_point_in_time_zscore(hot):
    plain = hot.select("txn_id", W.zscore_pit())
    for bucket in (7, DAY, 10**9):
        same(W.zscore_point_in_time(hot, bucket=bucket), plain, "amount_zscore_pit")


def test_zscore_beyond_exact_products(spark):
    """Sums whose squares pass 38 digits fall back to floating point."""
    t = spark.createDataFrame([(i, 1, i, 1e13 + i) for i in range(50)], "txn_id long, device_id int, t long, amount double")
    got = dict(W.zscore_point_in_time(t).select("txn_id", "amount_zscore_pit").collect())
    want = dict(t.select("txn_id", W.zscore_pit()).collect())
    assert got[0] is None and abs(got[49] - want[49]) <= 0.01 * abs(want[49])


def test_trailing_frames(hot):
    plain = hot.select("txn_id", W.rolling_mean_range(t="t"), *W.velocity_prior_cols())
    for bucket in (600, DAY):
        same(W.rolling_mean_7d(hot, t="t", bucket=bucket), plain, "avg_amount_7d")
    prior = W.velocity_prior(hot)
    for c in W.VELOCITY_WINDOWS:
        same(prior, plain, f"{c}_prior")
    w = Window.partitionBy("device_id").orderBy("t").rangeBetween(-5, 9)
    one = F.lit(1).cast("long")
    same(prefix.range_sums(hot, ["device_id"], "t", {"n": (one, -5, 9)}, bucket=3), hot.withColumn("n", F.count("*").over(w)), "n")
    w = Window.partitionBy("device_id").orderBy("t").rangeBetween(1, 3600)
    same(prefix.range_sums(hot, ["device_id"], "t", {"n": (one, 1, 3600)}), hot.withColumn("n", F.count("*").over(w)), "n")


def test_fifty_row_mean(hot):
    same(W.rolling_mean_chunked(hot, chunk_rows=60), hot.select("txn_id", W.rolling_mean_rows()), "avg_amount_50")


def test_previous_and_time_order(hot):
    w = Window.partitionBy("device_id").orderBy("k", "txn_id")
    same(prefix.previous(hot, ["device_id"], "k", "txn_id", "amount", "p", bucket=1), hot.withColumn("p", F.lag("amount").over(w)), "p")
    got = W.time_order_violations(hot, "device_id", "t", ["k", "txn_id"])
    want = (hot.withColumn("v", F.col("t") < F.lag("t").over(w)).groupBy("device_id").agg(F.count_if("v").alias("violations")))
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_attempts(hot):
    x = hot.withColumn("ts", F.timestamp_seconds("t"))
    w = Window.partitionBy("device_id", F.to_date("ts")).orderBy("ts", "txn_id")
    same(W.attempts_today(x, "device_id", "ts", "txn_id"), x.withColumn("attempts_today", F.row_number().over(w)), "attempts_today")


def test_text_ties_and_empty_tables(spark, hot):
    x = hot.withColumn("name", F.format_string("%08d", "txn_id"))
    w = Window.partitionBy("device_id").orderBy("t", "name").rowsBetween(Window.unboundedPreceding, -1)
    same(prefix.prefix_sums(x, ["device_id"], "t", "name", {"s": F.col("k")}), x.withColumn("s", F.coalesce(F.sum("k").over(w), F.lit(0))), "s")
    none = hot.limit(0)
    assert W.zscore_point_in_time(none).count() == W.velocity_prior(none).count() == W.rolling_mean_chunked(none).count() == 0


@pytest.mark.parametrize("op", [W.zscore_point_in_time, lambda d: W.rolling_mean_7d(d, t="t"), W.velocity_prior, W.rolling_mean_chunked])
def test_no_rows_are_dealt_by_device_alone(spark, hot, op):
    """Only sums per bucket, which are aggregated first, are partitioned by device."""
    plan = op(hot)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning(device_id" in line and "hashpartitioning(device_id#" in line:
            keys = line.split("hashpartitioning(")[1].split("), ")[0].split(", ")
            if len([k for k in keys if "#" in k]) == 1:
                assert "HashAggregate" in "".join(lines[i + 1: i + 4]), line


# ------------------------------------------------------------------ whole orders
@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=900) * 10.0 ** rng.integers(-300, 300, 900), rng.normal(size=900), 2.0 ** np.arange(-60, 60),
                        np.nextafter(2.0 ** np.arange(-60, 60), 0), -2.0 ** np.arange(0, 60), [0.0, 1e-310, 5e-324, -5e-324, 1.7e308, np.inf, -np.inf]])
    v = np.unique(v)
    return v, spark.createDataFrame([(float(x), i % 3, i) for i, x in enumerate(v)], "v double, g int, n long").repartition(3)


def test_cells_never_stand_out_of_order(numbers):
    v, t = numbers
    cell = dict(t.select("v", scale._digits(F.col("v")).alias("c")).collect())
    assert np.all(np.diff([cell[x] for x in v]) >= 0) and len(set(cell.values())) > 0.9 * len(v)


def test_running_sums_and_row_numbers(numbers):
    v, t = numbers
    got = {r.v: (r.cum_n, r.n) for r in scale.global_cumsum(t, ["v"], ["n"]).collect()}
    assert [got[x][0] for x in v] == np.cumsum(np.arange(len(v))).tolist()
    grouped = {r.v: r.cum_n for r in scale.global_cumsum(t, ["g", "v"], ["n"], group_col="g").collect()}
    for g in range(3):
        assert [grouped[x] for x in v[g::3]] == np.cumsum(np.arange(len(v))[g::3]).tolist()
    rows = scale.global_row_number(t.withColumn("b", F.pmod(F.col("n"), F.lit(5))), ["b", "n"]).collect()
    assert [r.row_num for r in sorted(rows, key=lambda r: (r.b, r.n))] == list(range(1, len(v) + 1))


def test_dates_times_and_nulls_first(spark):
    t = spark.sql("""SELECT id, IF(id = 3, NULL, date_add(DATE'1969-12-30', CAST(id AS INT))) AS d, timestamp_micros(id * 700000 - 4000000) AS ts,
                     CAST(timestamp_micros(id * 700000 - 4000000) AS TIMESTAMP_NTZ) AS tn FROM range(12)""")
    for c in ("ts", "tn"):
        assert all(r.row_num == r.id + 1 for r in scale.global_row_number(t, [c, "id"]).collect())
    got = {r.id: r.row_num for r in scale.global_row_number(t, ["d", "id"]).collect()}
    assert got == {3: 1, 0: 2, 1: 3, 2: 4, **{i: i + 1 for i in range(4, 12)}}


def test_no_job_before_the_action(spark, numbers):
    _, t = numbers
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "plans only")
    for df in (scale.exact_quantiles(t, "v", [0.1, 0.5], ["g"]), scale.percentile_rank(t, "v", t, "v"), scale.global_row_number(t, ["v", "n"])):
        assert df.columns
    assert not list(sc.statusTracker().getJobIdsForGroup("lazy"))
    sc.setJobGroup("rest", "")


def test_rows_dealt_by_key_are_dealt_anew_by_cell(spark):
    """Rows that come in dealt by key are no reason to do all levels in the same tasks."""
    df = spark.range(2000).select(F.col("id").alias("i"), (F.col("id") % 3).alias("k"), (F.col("id") % 2).alias("day"), (F.col("id") * 7 % 500).alias("t"))
    out = prefix.prefix_sums(df.repartition(4, "k"), ["k", "day"], "t", "i", {"n": F.lit(1).cast("long")}, bucket=50)
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(k" in line and "__block" in line for line in executed.splitlines()) >= 2  # the rows, and the last window
    rows = [(i, i % 3, i % 2, i * 7 % 500) for i in range(2000)]
    want = {i: sum((u, j) < (t, i) for j, l, e, u in rows if (l, e) == (k, d)) for i, k, d, t in rows[:300]}
    assert {r.i: r.n for r in out.where("i < 300").collect()} == want
