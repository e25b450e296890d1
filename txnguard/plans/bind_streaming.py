"""Queries for the Structured Streaming jobs.

Each query lands ``events``-derived rows as ordered Parquet files, runs the
stream with ``trigger(availableNow=True)`` and returns what the sink holds.
Where the stream's result is deterministic (ordered files, closed windows
below the final watermark) it has a DuckDB oracle equal to its batch twin.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from txnguard.catalog import query
from txnguard.operators import aggregates as A
from txnguard.operators import calibrate, policy, review
from txnguard.oracles import ORACLES, THR, TXN, with_
from txnguard.sources.tables import TIME_COMPRESSION, XGB_T_HIGH, XGB_T_LOW, txn
from txnguard.streaming import jobs

DELAY = "10 minutes"


def _txn_ms(spark, sf_dir):
    """Transactions with a millisecond-rounded event time (reader-independent)."""
    t = txn(spark, sf_dir)
    ms = F.round(F.unix_micros("ts") / 1000.0).cast("long")
    return t.withColumn("et", F.timestamp_millis(ms))


def _stream(spark, sf_dir, name, order_col="t", split_col=None, n_files=4, cols=None):
    t = _txn_ms(spark, sf_dir)
    if cols:
        t = t.select(*cols)
    path = jobs.landing(spark, t, name, order_col if split_col is None else None, n_files, split_col)
    return jobs.read_stream(spark, path, t.schema), t


def _out(spark, name):
    return jobs.work_dir(spark, "runs", f"{name}-{uuid.uuid4().hex[:8]}")


# ---------------------------------------------------------------- scoring
@query("stream_score_decisions", ORACLES["policy_api"])
def q_stream_score(spark, sf_dir):
    """Score + decide each micro-batch against static thresholds (broadcast
    one-row table), appended per batch id (idempotent on replay)."""
    stream, t = _stream(spark, sf_dir, "score")
    thr = calibrate.percentile_thresholds(txn(spark, sf_dir)).select(
        F.col("review").alias("ae_review"), F.col("block").alias("ae_block"))
    thr_rows = thr.collect()  # one row
    thr_static = spark.createDataFrame(thr_rows, thr.schema)
    s = stream.crossJoin(F.broadcast(thr_static))
    gray = policy.in_gray_zone("p_xgb", XGB_T_LOW, XGB_T_HIGH)
    s = s.withColumn("ae_bucket", policy.ae_bucket(F.when(gray, F.col("ae_err")), "ae_review", "ae_block"))
    s = s.select("txn_id", "et", *policy.policy_api("p_xgb", "ae_bucket", XGB_T_LOW, XGB_T_HIGH), "ae_bucket")
    out = _out(spark, "score")
    body = jobs.foreach_batch_to(out + "/data", lambda b, i: b.withColumn(
        "reason_codes", F.array_join("reason_codes", ",")))
    jobs.run_available(s.writeStream.foreachBatch(body).option("checkpointLocation", out + "/chk"))
    return spark.read.parquet(out + "/data").select("txn_id", "decision", "ae_bucket", "reason_codes")


@query("stream_dedupe_payloads")
def q_stream_dedupe(spark, sf_dir):
    """One row per payload hash within the watermark delay (rows-only: which
    duplicate survives depends on arrival order)."""
    stream, _ = _stream(spark, sf_dir, "dedupe")
    h = F.sha2(F.concat_ws("|", F.col("event_type"), F.col("k").cast("string")), 256)
    d = stream.withColumn("payload_hash", h).withWatermark("et", "1 hour").dropDuplicatesWithinWatermark(["payload_hash"])
    out = _out(spark, "dedupe")
    jobs.run_available(d.select("txn_id", "payload_hash", "et").writeStream.format("parquet")
                       .option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    return spark.read.parquet(out + "/data")


ET_SQL = """tm AS (SELECT *, make_timestamp(CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) * 1000) AS et FROM txn),
mx AS (SELECT max(et) - INTERVAL 10 MINUTE AS wm FROM tm)"""


@query("stream_velocity_window", with_(TXN, ET_SQL) + """
, w AS (SELECT device_id, time_bucket(INTERVAL 5 MINUTE, et) - to_minutes(5 * r.k) AS window_start
        FROM tm, range(0, 12) r(k))
SELECT device_id, window_start, window_start + INTERVAL 60 MINUTE AS window_end, count(*) AS n
FROM w, mx WHERE window_start + INTERVAL 60 MINUTE <= mx.wm GROUP BY device_id, window_start""")
def q_stream_window(spark, sf_dir):
    """60-minute windows sliding every 5 minutes per device, append mode:
    a window is emitted once the watermark passes its end."""
    stream, t = _stream(spark, sf_dir, "vwin", cols=["device_id", "t", "et"])
    stream = jobs.deal(stream, ["device_id", "et"], t.count())  # a row goes to 12 windows
    agg = (stream.withWatermark("et", DELAY).groupBy(F.window("et", "60 minutes", "5 minutes"), "device_id")
           .agg(F.count(F.lit(1)).alias("n")))
    out = _out(spark, "vwin")
    jobs.run_available(agg.select("device_id", F.col("window.start").alias("window_start"),
                                  F.col("window.end").alias("window_end"), "n")
                       .writeStream.format("parquet").outputMode("append")
                       .option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    return spark.read.parquet(out + "/data")


@query("stream_velocity_windows", with_(TXN, ET_SQL) + """
, w AS (SELECT device_id, m.minutes, time_bucket(INTERVAL 5 MINUTE, et) - to_minutes(5 * r.k) AS window_start
        FROM tm, (VALUES (5), (30)) m(minutes), range(0, 6) r(k) WHERE 5 * r.k < m.minutes)
SELECT device_id, CAST(minutes AS INTEGER) AS minutes, window_start, window_start + to_minutes(minutes) AS window_end, count(*) AS n
FROM w, mx WHERE window_start + to_minutes(minutes) <= mx.wm GROUP BY device_id, minutes, window_start""")
def q_stream_windows(spark, sf_dir):
    """The 5- and 30-minute counts beside the 60-minute ones, sliding by 5 minutes."""
    stream, t = _stream(spark, sf_dir, "vwins", cols=["device_id", "t", "et"])
    stream = jobs.deal(stream, ["device_id", "et"], t.count())  # a row goes to 6 windows
    parts = []
    for minutes in (5, 30):
        out = _out(spark, f"vwin{minutes}")
        agg = (stream.withWatermark("et", DELAY).groupBy(F.window("et", f"{minutes} minutes", "5 minutes"), "device_id")
               .agg(F.count(F.lit(1)).alias("n")))
        jobs.run_available(agg.select("device_id", F.lit(minutes).alias("minutes"), F.col("window.start").alias("window_start"),
                                      F.col("window.end").alias("window_end"), "n")
                           .writeStream.format("parquet").outputMode("append")
                           .option("path", out + "/data").option("checkpointLocation", out + "/chk"))
        parts.append(spark.read.parquet(out + "/data"))
    return parts[0].unionByName(parts[1])


VEL_SQL = ORACLES["win_velocity_inclusive"]


@query("stream_velocity_stateful", VEL_SQL)
def q_stream_stateful(spark, sf_dir):
    """Exact per-event 5/30/60 trailing counts per device, in state of (bucket of
    devices, time chunk) that expires; equals the batch window operator."""
    stream, t = _stream(spark, sf_dir, "vstate", cols=["txn_id", "device_id", "t", "et"])
    v = jobs.stateful_velocity(stream, "et", DELAY, seconds_per_unit=TIME_COMPRESSION, buckets=jobs.device_buckets(spark, t.count()))
    out = _out(spark, "vstate")
    jobs.run_available(v.writeStream.format("parquet").outputMode("append")
                       .option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    return spark.read.parquet(out + "/data").select("txn_id", "txn_count_5m", "txn_count_30m", "txn_count_60m")


@query("stream_session_bursts", with_(TXN, ET_SQL) + """
, g AS (SELECT device_id, et, CASE WHEN lag(et) OVER (PARTITION BY device_id ORDER BY et) IS NULL
               OR et >= lag(et) OVER (PARTITION BY device_id ORDER BY et) + INTERVAL 5 MINUTE THEN 1 ELSE 0 END AS brk FROM tm),
s AS (SELECT *, sum(brk) OVER (PARTITION BY device_id ORDER BY et ROWS UNBOUNDED PRECEDING) AS sid FROM g),
ss AS (SELECT device_id, min(et) AS session_start, max(et) + INTERVAL 5 MINUTE AS session_end, count(*) AS n
       FROM s GROUP BY device_id, sid)
SELECT ss.* FROM ss, mx WHERE session_end <= mx.wm""")
def q_stream_sessions(spark, sf_dir):
    """Session windows (5-minute gap) per device; closed sessions only."""
    stream, _ = _stream(spark, sf_dir, "sess")
    agg = (stream.withWatermark("et", DELAY).groupBy(F.session_window("et", "5 minutes"), "device_id")
           .agg(F.count(F.lit(1)).alias("n")))
    out = _out(spark, "sess")
    jobs.run_available(agg.select("device_id", F.col("session_window.start").alias("session_start"),
                                  F.col("session_window.end").alias("session_end"), "n")
                       .writeStream.format("parquet").outputMode("append")
                       .option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    return spark.read.parquet(out + "/data")


@query("stream_decision_rates", with_(TXN, THR, ET_SQL) + """
, d AS (SELECT time_bucket(INTERVAL 1 HOUR, et) AS window_start,
          CASE WHEN p_xgb < 0.05 THEN 'APPROVE' WHEN p_xgb >= 0.8 THEN 'BLOCK'
               WHEN (CASE WHEN p_xgb >= 0.05 AND p_xgb < 0.8 THEN ae_err END) >= thr.ae_block THEN 'BLOCK' ELSE 'REVIEW' END
          AS decision FROM tm, thr),
c AS (SELECT window_start, decision, count(*) AS n FROM d GROUP BY ALL)
SELECT c.window_start, decision, n, round(n / sum(n) OVER (PARTITION BY c.window_start), 6) AS rate
FROM c, mx WHERE c.window_start + INTERVAL 1 HOUR <= mx.wm""")
def q_stream_rates(spark, sf_dir):
    """Decision counts per tumbling hour (closed windows), then shares."""
    stream, _ = _stream(spark, sf_dir, "rates")
    thr = calibrate.percentile_thresholds(txn(spark, sf_dir)).select(
        F.col("review").alias("ae_review"), F.col("block").alias("ae_block"))
    thr_static = spark.createDataFrame(thr.collect(), thr.schema)  # one row
    s = stream.crossJoin(F.broadcast(thr_static))
    gray = policy.in_gray_zone("p_xgb", XGB_T_LOW, XGB_T_HIGH)
    s = s.withColumn("ae_bucket", policy.ae_bucket(F.when(gray, F.col("ae_err")), "ae_review", "ae_block"))
    s = s.select("et", *policy.policy_api("p_xgb", "ae_bucket", XGB_T_LOW, XGB_T_HIGH))
    agg = s.withWatermark("et", DELAY).groupBy(F.window("et", "1 hour"), "decision").agg(F.count(F.lit(1)).alias("n"))
    out = _out(spark, "rates")
    jobs.run_available(agg.select(F.col("window.start").alias("window_start"), "decision", "n")
                       .writeStream.format("parquet").outputMode("append")
                       .option("path", out + "/data").option("checkpointLocation", out + "/chk"))
    r = spark.read.parquet(out + "/data")
    from pyspark.sql import Window
    return r.withColumn("rate", A.r6(F.col("n") / F.sum("n").over(Window.partitionBy("window_start"))))


LATE_SQL = """f AS (SELECT *, txn_id % 4 AS part FROM tm),
pm AS (SELECT part, max(et) AS mx FROM f GROUP BY part),
prev AS (SELECT a.part, max(b.mx) AS max_prev FROM (SELECT DISTINCT part FROM f) a LEFT JOIN pm b ON b.part < a.part GROUP BY a.part)"""


@query("stream_late_events", with_(TXN, ET_SQL, LATE_SQL) + """
SELECT f.part AS batch, count(*) FILTER (WHERE prev.max_prev IS NULL OR f.et >= prev.max_prev) AS n_on_time,
       count(*) FILTER (WHERE f.et < prev.max_prev) AS n_late
FROM f JOIN prev USING (part) GROUP BY f.part""")
def q_stream_late(spark, sf_dir):
    """Rows older than the largest event time seen in earlier batches are
    counted and quarantined (foreachBatch; the running max is kept in a
    small per-batch table so a replayed batch recomputes the same split)."""
    t = _txn_ms(spark, sf_dir).withColumn("part", F.pmod("txn_id", F.lit(4)))
    path = jobs.landing(spark, t, "late", None, 4, split_col="txn_id")
    stream = jobs.read_stream(spark, path, t.schema)
    out = _out(spark, "late")

    def body(batch, batch_id):
        prev = None
        if jobs.exists(spark, out + "/maxts"):  # not before the first batch
            prev = spark.read.parquet(out + "/maxts").where(F.col("batch_id") < batch_id).agg(F.max("max_et")).first()[0]
        late = F.col("et") < F.lit(prev) if prev is not None else F.lit(False)
        b = batch.withColumn("late", late)
        b.where("late").write.mode("overwrite").parquet(f"{out}/quarantine/batch_id={batch_id}")
        stats = b.agg(F.count_if(~F.col("late")).alias("n_on_time"), F.count_if("late").alias("n_late"),
                      F.max("et").alias("max_et"), F.max("part").alias("batch"))
        stats.write.mode("overwrite").parquet(f"{out}/maxts/batch_id={batch_id}")
    jobs.run_available(stream.writeStream.foreachBatch(body).option("checkpointLocation", out + "/chk"))
    return spark.read.parquet(out + "/maxts").select("batch", "n_on_time", "n_late")


def _review_state_sql():
    from txnguard.plans.bind_review import ST
    return ST + """
SELECT review_id, status, analyst, analyst_decision, notes, round(score_xgb, 6) AS score_xgb, round(ae_error, 6) AS ae_error,
       ae_bucket, shap_path, created, updated FROM st"""


@query("stream_review_state", _review_state_sql())
def q_stream_review(spark, sf_dir):
    """Review events streamed in four batches; each batch folds and writes
    only the buckets of the reviews that it touches."""
    from txnguard.plans.bind_review import decisions, review_events
    ev = review_events(decisions(spark, sf_dir))
    path = jobs.landing(spark, ev, "revents", "ts", 4)
    stream = jobs.read_stream(spark, path, ev.schema)
    out = _out(spark, "rstate")
    state = jobs.BucketedState(spark, out, "review_id", review.fold_review_state)
    last = []
    jobs.run_available(stream.writeStream.foreachBatch(lambda batch, i: last.append(i) if state.apply(batch, i) is not None else None)
                       .option("checkpointLocation", out + "/chk"))
    st = state.read(max(last))
    return st.select("review_id", "status", "analyst", "analyst_decision", "notes",
                     A.r6(F.col("score_xgb")).alias("score_xgb"), A.r6(F.col("ae_error")).alias("ae_error"),
                     "ae_bucket", "shap_path", "created", "updated")


MONITORED = ["amount", "event_type", "k"]


def _monitor_sql() -> str:
    from txnguard.plans.bind_drift import psi_sql
    parts = [f"SELECT {i} AS batch_id, feature, round(psi, 6) AS psi, status FROM (WITH "
             + psi_sql(MONITORED, "ts < TIMESTAMP '2024-01-16'", f"txn_id % 4 = {i}") + " SELECT * FROM rep)" for i in range(4)]
    return with_(TXN) + "\nUNION ALL ".join(parts)


@query("stream_drift_monitor", _monitor_sql())
def q_stream_drift(spark, sf_dir):
    """PSI of each micro-batch against the baseline (first half of the month),
    which is read once; batch i holds the rows with txn_id % 4 = i."""
    stream, t = _stream(spark, sf_dir, "drift", split_col="txn_id")
    out = _out(spark, "drift")
    monitor = jobs.DriftMonitor(spark, out, MONITORED)
    monitor.fit(t.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp")))
    jobs.run_available(stream.writeStream.foreachBatch(monitor.apply).option("checkpointLocation", out + "/chk"))
    return monitor.report().select("batch_id", "feature", A.r6(F.col("psi")).alias("psi"), "status")
