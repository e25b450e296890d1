"""Queries for scans and sinks.  Writes go to fresh folders
under the cluster checkpoint location and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.operators import aggregates as A
from txnguard.operators import windows
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.plans.scale import global_row_number
from txnguard.sources import io
from txnguard.sources.tables import read_table, txn


@query("scan_table", """
SELECT event_id, event_type, value FROM events
ORDER BY (event_id * 2654435761) % 4294967296, event_id LIMIT 500""")
def q_scan_table(spark, sf_dir):
    df = io.scan_table(spark, f"{sf_dir}/events.parquet", sample_n=500, key="event_id")
    return df.select("event_id", "event_type", "value")


@query("scan_feature_label_split", with_(TXN) + """
SELECT label, count(*) AS n, 6 AS n_feature_columns FROM txn GROUP BY label""")
def q_feature_label(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "device_id", "amount", "k", "p_xgb", "ae_err", "label")
    x, y = io.feature_label_split(t, "label")
    return y.groupBy("label").count().withColumnRenamed("count", "n").withColumn("n_feature_columns",
                                                                                 F.lit(len(x.columns)))


@query("scan_fallback_chain", "SELECT count(*) AS n, 'events' AS source FROM events")
def q_fallback(spark, sf_dir):
    missing = io.scratch_path(spark, "absent") + "/enriched.parquet"
    used, df = io.fallback_chain(spark, [missing, f"{sf_dir}/events.parquet", f"{sf_dir}/orders.parquet"])
    return df.agg(F.count(F.lit(1)).alias("n")).withColumn("source", F.lit(used.rsplit("/", 1)[-1].split(".")[0]))


PAYLOAD_FEATURES = ["num__amount", "num__p", "num__k", "num__missing"]


@query("scan_json_payloads", with_(TXN) + """
SELECT txn_id, amount AS num__amount, p_xgb AS num__p, CASE WHEN event_type = 'view' THEN 0.0 ELSE CAST(k AS DOUBLE) END
       AS num__k, 0.0 AS num__missing FROM txn""")
def q_json_payloads(spark, sf_dir):
    """Payload documents (k omitted for views) written as JSON in nested
    day folders, read back recursively into fixed-width feature rows."""
    t = txn(spark, sf_dir)
    feats = F.map_filter(F.create_map(F.lit("num__amount"), F.col("amount"), F.lit("num__p"), F.col("p_xgb"),
                                      F.lit("num__k"), F.when(F.col("event_type") != "view", F.col("k").cast("double"))),
                         lambda k, v: v.isNotNull())
    docs = t.select("txn_id", feats.alias("features"), F.to_date("ts").cast("string").alias("day"))
    path = io.write_json_records(docs, io.scratch_path(spark, "payloads"), "txn_id", partition_by=["day"])
    return io.json_payloads(spark, path, PAYLOAD_FEATURES)


@query("scan_snapshot_by_path")
def q_snapshot_by_path(spark, sf_dir):
    """Feature snapshots written once as a table keyed by path, joined to
    the reviews that reference them (no per-row file reads)."""
    from txnguard.plans.bind_review import decisions, opened_reviews, snapshots
    d = decisions(spark, sf_dir)
    snap_path = io.write_table(snapshots(d), io.scratch_path(spark, "snapshots"))
    rv = opened_reviews(d).select("review_id", "feature_path")
    return rv.join(spark.read.parquet(snap_path), "feature_path").select("review_id", "feature_path", "num__amount", "num__p")


def _snapshot_sql():
    from txnguard.plans.bind_review import SNAP_SQL, STORE_SQL
    return with_(TXN, THR, SCORED, STORE_SQL, SNAP_SQL) + """
SELECT review_id, feature_path, num__amount, num__p FROM rv JOIN snap USING (feature_path)"""


from txnguard.catalog import ORACLE_SQL  # noqa: E402

ORACLE_SQL["scan_snapshot_by_path"] = _snapshot_sql()


@query("scan_store_table", with_(TXN, THR, SCORED) + """
SELECT txn_id AS id, decision, p_xgb AS score_xgb FROM scored WHERE CAST(ts AS DATE) = DATE '2024-01-20'""")
def q_store_table(spark, sf_dir):
    """Decision log written partitioned by day; a one-day read prunes to one
    partition folder."""
    s = scored_txn(spark, sf_dir).select(F.col("txn_id").alias("id"), "decision", F.col("p_xgb").alias("score_xgb"),
                                         F.to_date("ts").alias("day"))
    path = io.write_table(s, io.scratch_path(spark, "decisions"), partition_by=["day"])
    return spark.read.parquet(path).where(F.col("day") == F.lit("2024-01-20").cast("date")).drop("day")


@query("scan_error_vector", with_(TXN) + """
SELECT row_number() OVER (ORDER BY ae_err, txn_id) AS rank, ae_err FROM txn WHERE label = 0""")
def q_error_vector(spark, sf_dir):
    """Sorted legit error baseline: read if cached, else built and written."""
    path = io.scratch_path(spark, "ae_baseline")
    if not io.path_exists(spark, path):
        legit = txn(spark, sf_dir).where(F.col("label") == 0).select("txn_id", "ae_err")
        io.write_table(global_row_number(legit, ["ae_err", "txn_id"], "rank"), path)
    return spark.read.parquet(path).select("rank", "ae_err")


def run_stats(spark, sf_dir):
    """Per-run request statistics in the load-tool CSV layout: an
    'Aggregated' row (written only for runs on even days), endpoint rows."""
    from txnguard.plans.bindings import requests
    r = requests(spark, sf_dir).withColumn("run", F.col("run_id").cast("string"))
    ep = r.withColumn("Type", F.when(F.col("status_code") == 404, "GET").otherwise("POST")).withColumn(
        "Name", F.when(F.col("status_code") == 404, "/health").otherwise("/preauth/decision"))
    per = ep.groupBy("run", "Type", "Name").agg(F.count(F.lit(1)).alias("Request Count"),
                                               F.count_if(~F.col("ok")).alias("Failure Count"))
    agg = (r.where(F.dayofmonth("run_id") % 2 == 0).groupBy("run")
           .agg(F.count(F.lit(1)).alias("Request Count"), F.count_if(~F.col("ok")).alias("Failure Count"))
           .select("run", F.lit("").alias("Type"), F.lit("Aggregated").alias("Name"), "Request Count", "Failure Count"))
    return per.unionByName(agg)


@query("scan_run_stats", """
WITH r AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS run, event_type FROM events),
ep AS (SELECT run, CASE WHEN event_type = 'signup' THEN '/health' ELSE '/preauth/decision' END AS name,
              count(*) AS n, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS f FROM r GROUP BY ALL),
ag AS (SELECT run, 'Aggregated' AS name, count(*) AS n, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS f
       FROM r WHERE day(CAST(run AS DATE)) % 2 = 0 GROUP BY run),
u AS (SELECT * FROM ep UNION ALL SELECT * FROM ag)
SELECT run, name, n AS request_count, f AS failure_count FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN name = 'Aggregated' THEN 0
                                                            WHEN name = '/preauth/decision' THEN 1 ELSE 2 END, name) AS rn
  FROM u) WHERE rn = 1""")
def q_run_stats(spark, sf_dir):
    from pyspark.sql import Window
    path = io.write_table(run_stats(spark, sf_dir), io.scratch_path(spark, "run_stats"), fmt="csv")
    s = spark.read.option("header", True).option("inferSchema", False).csv(path)
    pri = (F.when(F.col("Name") == "Aggregated", 0).when(F.col("Name") == "/preauth/decision", 1).otherwise(2))
    w = Window.partitionBy("run").orderBy(pri, F.col("Name"))
    best = s.withColumn("__rn", F.row_number().over(w)).where("__rn = 1")
    return best.select("run", F.col("Name").alias("name"), F.col("Request Count").cast("long").alias("request_count"),
                       F.col("Failure Count").cast("long").alias("failure_count"))


@query("sink_splits", with_(TXN) + """
SELECT split, count(*) AS n FROM (
  SELECT CASE WHEN rn - 1 < floor(n * 0.70) THEN 'train' WHEN rn - 1 < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT row_number() OVER (ORDER BY ts, txn_id) AS rn, count(*) OVER () AS n FROM txn)) GROUP BY split""")
def q_sink_splits(spark, sf_dir):
    s = windows.time_split(txn(spark, sf_dir).select("txn_id", "ts", "amount", "label"), ["ts", "txn_id"])
    path = io.write_table(s, io.scratch_path(spark, "splits"), partition_by=["split"])
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("sink_table_csv_or_parquet", with_(TXN) + "SELECT 'parquet' AS format, count(*) AS n FROM txn")
def q_sink_fallback(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "amount", "label")
    fmt, path = io.write_with_fallback(t, io.scratch_path(spark, "enriched"))
    return spark.read.format(fmt).load(path).agg(F.count(F.lit(1)).alias("n")).withColumn("format", F.lit(fmt))


@query("sink_snapshot_json", with_(TXN, THR, SCORED) + """
SELECT txn_id, amount, p_xgb FROM scored WHERE decision = 'REVIEW'""")
def q_sink_snapshot(spark, sf_dir):
    s = scored_txn(spark, sf_dir).where(F.col("decision") == "REVIEW").select("txn_id", "amount", "p_xgb")
    path = io.write_json_records(s, io.scratch_path(spark, "snapshots_json"), "txn_id")
    back = spark.read.text(path).select(F.from_json("value", "txn_id long, amount double, p_xgb double").alias("r"))
    return back.select("r.*")


@query("sink_audit_log", with_(TXN, THR, SCORED) + """
SELECT txn_id, decision, ae_bucket, reason_codes FROM scored""")
def q_audit(spark, sf_dir):
    s = scored_txn(spark, sf_dir).select("txn_id", "decision", "ae_bucket", "reason_codes")
    path = io.write_json_records(s, io.scratch_path(spark, "audit"), "txn_id")
    back = spark.read.text(path).select(F.from_json(
        "value", "txn_id long, decision string, ae_bucket string, reason_codes array<string>").alias("r"))
    return back.select("r.txn_id", "r.decision", "r.ae_bucket", F.array_join("r.reason_codes", ",").alias("reason_codes"))


@query("sink_report")
def q_report(spark, sf_dir):
    """Check results as a long-form report table (written), plus the
    Markdown rendering of that small table."""
    from txnguard.operators import quality
    from txnguard.plans.bindings import features_txn
    rep = quality.missing_key_columns(features_txn(spark, sf_dir, []), ["txn_id", "amount", "label", "billing_country"])
    path = io.write_table(rep, io.scratch_path(spark, "report"))
    rows = spark.read.parquet(path).orderBy("column").collect()  # a handful of check rows
    md = "\n".join(["| column | missing | passed |", "|---|---|---|"]
                   + [f"| {r['column']} | {r['n_missing']} | {r['passed']} |" for r in rows])
    return spark.read.parquet(path).withColumn("markdown_lines", F.lit(len(md.splitlines())))


@query("sink_reproducibility_signature")
def q_signature(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "amount", "label")
    return io.whole_signature(t)


del A, read_table
