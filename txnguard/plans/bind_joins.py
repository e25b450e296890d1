"""Queries for joins, remaining windows, set operations and top-k
(SURVEY 2.3, 2.5, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.operators import aggregates as A
from txnguard.operators import metrics, setops, windows
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.plans.bindings import FEAT_SQL, features_txn
from txnguard.plans.scale import percentile_rank
from txnguard.sources.tables import country_dim, read_table, txn

SC = with_(TXN, THR, SCORED)
CUTOFF = "2024-01-16"


@query("join_country_dim", with_(TXN, FEAT_SQL) + "SELECT txn_id, lat_b, lon_b, lat_s, lon_s FROM feat")
def q_country_dim(spark, sf_dir):
    t = txn(spark, sf_dir)
    cust = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("device_id"),
                                                        F.col("c_nationkey").alias("bk"))
    dim = country_dim(spark, sf_dir)  # bounded by the nation table -> broadcast
    b = F.broadcast(dim.select(F.col("country_key").alias("bk"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b")))
    s = F.broadcast(dim.select(F.col("country_key").alias("sk"), F.col("lat").alias("lat_s"), F.col("lon").alias("lon_s")))
    j = (t.join(cust, "device_id", "left").withColumn("sk", F.pmod("k", F.lit(25)))
         .join(b, "bk", "left").join(s, "sk", "left"))
    return j.select("txn_id", "lat_b", "lon_b", "lat_s", "lon_s")


@query("join_scores_to_labels", with_(TXN) + """
, sc AS (SELECT txn_id, ae_err FROM txn WHERE event_type <> 'view'), lb AS (SELECT txn_id, label FROM txn)
SELECT (SELECT count(*) FROM sc) AS n_scores, (SELECT count(*) FROM lb) AS n_labels,
       (SELECT count(*) FROM sc JOIN lb USING (txn_id)) AS n_joined,
       (SELECT count(*) FROM sc) = (SELECT count(*) FROM lb) AS aligned""")
def q_scores_labels(spark, sf_dir):
    """Keyed alignment of a score vector with labels; ``aligned`` is the
    length check (the binding drops 'view' rows from the scores)."""
    t = txn(spark, sf_dir)
    sc = t.where(F.col("event_type") != "view").select("txn_id", "ae_err")
    lb = t.select("txn_id", "label")
    j = sc.join(lb, "txn_id")
    out = (sc.agg(F.count(F.lit(1)).alias("n_scores")).crossJoin(lb.agg(F.count(F.lit(1)).alias("n_labels")))
           .crossJoin(j.agg(F.count(F.lit(1)).alias("n_joined"))))
    return out.withColumn("aligned", F.col("n_scores") == F.col("n_labels"))


@query("join_percentile_vs_baseline", with_(TXN) + """
, base AS (SELECT ae_err FROM txn WHERE label = 0), n AS (SELECT count(*) AS n FROM base),
v AS (SELECT DISTINCT ae_err FROM txn),
r AS (SELECT v.ae_err, 100.0 * count(base.ae_err) / (SELECT n FROM n) AS pct FROM v LEFT JOIN base ON base.ae_err <= v.ae_err
      GROUP BY v.ae_err)
SELECT txn_id, round(pct, 6) AS pct_rank FROM txn JOIN r USING (ae_err)""")
def q_pct_baseline(spark, sf_dir):
    t = txn(spark, sf_dir)
    r = percentile_rank(t.select("txn_id", "ae_err"), "ae_err", t.where(F.col("label") == 0), "ae_err", "pct_rank")
    return r.select("txn_id", A.r6(F.col("pct_rank")).alias("pct_rank"))


@query("join_category_alignment", with_(TXN) + """
, a AS (SELECT event_type AS category, count(*) AS n FROM txn WHERE ts < TIMESTAMP '2024-01-16' AND k < 90 GROUP BY 1),
b AS (SELECT event_type AS category, count(*) AS n FROM txn WHERE ts >= TIMESTAMP '2024-01-16' AND k >= 10 GROUP BY 1)
SELECT coalesce(a.category, b.category) AS category, coalesce(a.n, 0) AS n_baseline, coalesce(b.n, 0) AS n_current
FROM a FULL OUTER JOIN b ON a.category = b.category""")
def q_category_alignment(spark, sf_dir):
    t = txn(spark, sf_dir)
    cut = F.lit(CUTOFF).cast("timestamp")
    a = t.where((F.col("ts") < cut) & (F.col("k") < 90)).groupBy(F.col("event_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n_baseline"))
    b = t.where((F.col("ts") >= cut) & (F.col("k") >= 10)).groupBy(F.col("event_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n_current"))
    return a.join(b, "category", "full_outer").fillna(0, ["n_baseline", "n_current"])


@query("join_fn_scenarios", SC + """
, tpl AS (SELECT * FROM (VALUES ('proxy_on'), ('new_device'), ('night_time')) v(template))
SELECT s.txn_id, tpl.template FROM scored s, tpl WHERE s.decision = 'REVIEW'""")
def q_fn_scenarios(spark, sf_dir):
    s = scored_txn(spark, sf_dir).where(F.col("decision") == "REVIEW").select("txn_id")
    tpl = spark.createDataFrame([("proxy_on",), ("new_device",), ("night_time",)], "template string")
    return s.crossJoin(F.broadcast(tpl))  # fixed 3-row template list


# ---------------------------------------------------------------- windows
@query("win_time_order_violations", with_(TXN) + """
SELECT device_id, CAST(count(*) FILTER (WHERE v) AS BIGINT) AS violations FROM (
  SELECT device_id, t < lag(t) OVER (PARTITION BY device_id ORDER BY k, txn_id) AS v FROM txn) GROUP BY device_id""")
def q_order_violations(spark, sf_dir):
    return windows.time_order_violations(txn(spark, sf_dir), "device_id", "t", ["k", "txn_id"])


@query("win_first_txn_rate", with_(TXN, FEAT_SQL) + """
SELECT count(*) FILTER (WHERE is_new_device) AS n_first,
       round(avg(CASE WHEN txn_count_5m = 1 THEN 1.0 ELSE 0.0 END) FILTER (WHERE is_new_device), 6) AS velocity1_rate
FROM feat""")
def q_first_rate(spark, sf_dir):
    f = features_txn(spark, sf_dir, ["is_new_device", "txn_count_5m"])
    return f.agg(F.count_if("is_new_device").alias("n_first"),
                 A.r6(F.avg(F.when(F.col("is_new_device"), (F.col("txn_count_5m") == 1).cast("double"))))
                 .alias("velocity1_rate"))


@query("win_global_monotonic", """
SELECT coalesce(bool_and(d), true) AS is_monotonic, count(*) FILTER (WHERE NOT d) AS n_decreases FROM (
  SELECT lag(ts) OVER (ORDER BY event_id) <= ts AS d FROM events) WHERE d IS NOT NULL""")
def q_monotonic(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts")
    return windows.global_monotonic(ev, "ts", "event_id")


@query("win_time_split", """
SELECT o_orderkey, CASE WHEN rn - 1 < floor(n * 0.70) THEN 'train' WHEN rn - 1 < floor(n * 0.85) THEN 'val' ELSE 'test' END
       AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)""")
def q_time_split(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    return windows.time_split(o, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "split")


# ---------------------------------------------------------------- sets
@query("set_union_dedupe", with_(TXN) + """
SELECT DISTINCT device_id, event_type, k FROM txn""")
def q_union_dedupe(spark, sf_dir):
    t = txn(spark, sf_dir).select("device_id", "event_type", "k", "ts")
    cut = F.lit(CUTOFF).cast("timestamp")
    base = t.where(F.col("ts") < cut).drop("ts")
    fb = t.where(F.col("ts") >= cut).drop("ts")
    return setops.union_dedupe(base, fb)


SPLIT_SQL = """sp AS (
  SELECT *, CASE WHEN rn - 1 < floor(n * 0.70) THEN 'train' WHEN rn - 1 < floor(n * 0.85) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY ts, txn_id) AS rn, count(*) OVER () AS n FROM txn)),
ks AS (SELECT DISTINCT split, device_id, event_type, k FROM sp)"""


@query("set_split_overlap", with_(TXN, SPLIT_SQL) + """
SELECT a.s AS split_a, b.s AS split_b, (SELECT count(*) FROM (SELECT device_id, event_type, k FROM ks WHERE split = a.s
        INTERSECT SELECT device_id, event_type, k FROM ks WHERE split = b.s)) AS n_overlap
FROM (VALUES ('train', 1), ('val', 2), ('test', 3)) a(s, i), (VALUES ('train', 1), ('val', 2), ('test', 3)) b(s, i)
WHERE a.i < b.i""")
def q_split_overlap(spark, sf_dir):
    s = windows.time_split(txn(spark, sf_dir), ["ts", "txn_id"])
    return setops.split_overlap(s, "split", ["device_id", "event_type", "k"])


@query("set_column_diff")
def q_column_diff(spark, sf_dir):
    return setops.column_diff(spark, txn(spark, sf_dir), features_txn(spark, sf_dir))


@query("set_common_features")
def q_common_features(spark, sf_dir):
    t = txn(spark, sf_dir)
    cols = setops.common_features(t, features_txn(spark, sf_dir), allow=["amount", "k", "p_xgb", "geo_distance_km"])
    return t.select(*cols).agg(*[A.r6(F.avg(c)).alias(f"mean_{c}") for c in cols])


@query("set_dedupe_by_canonical_row", with_(TXN) + """
SELECT txn_id, event_type, k FROM (SELECT *, row_number() OVER (PARTITION BY event_type, k ORDER BY txn_id) AS rn FROM txn)
WHERE rn = 1""")
def q_dedupe_canonical(spark, sf_dir):
    return setops.dedupe_by_canonical_row(txn(spark, sf_dir), ["event_type", "k"], ["txn_id"]).select(
        "txn_id", "event_type", "k")


# ---------------------------------------------------------------- top-k
@query("topk_closest_to_mid", SC + """
SELECT txn_id, p_xgb FROM scored WHERE p_xgb >= 0.05 AND p_xgb < 0.8
ORDER BY abs(p_xgb - (CAST(0.05 AS DOUBLE) + CAST(0.8 AS DOUBLE)) / 2), txn_id LIMIT 20""")
def q_closest(spark, sf_dir):
    s = scored_txn(spark, sf_dir).where((F.col("p_xgb") >= 0.05) & (F.col("p_xgb") < 0.8))
    return setops.closest_to(s, "p_xgb", (0.05 + 0.8) / 2, "txn_id", 20).select("txn_id", "p_xgb")


@query("topk_extreme_scores", with_(TXN) + """
(SELECT 'lowest' AS side, txn_id, p_xgb FROM txn WHERE p_xgb >= 0.05 AND p_xgb < 0.8 ORDER BY p_xgb, txn_id LIMIT 10)
UNION ALL
(SELECT 'highest', txn_id, p_xgb FROM txn WHERE p_xgb >= 0.05 AND p_xgb < 0.8 ORDER BY p_xgb DESC, txn_id LIMIT 10)""")
def q_extremes(spark, sf_dir):
    t = txn(spark, sf_dir)
    lo = setops.extremes_in_band(t, "p_xgb", 0.05, 0.8, "txn_id", 10, False).select(F.lit("lowest").alias("side"), "txn_id", "p_xgb")
    hi = setops.extremes_in_band(t, "p_xgb", 0.05, 0.8, "txn_id", 10, True).select(F.lit("highest").alias("side"), "txn_id", "p_xgb")
    return lo.unionByName(hi)


@query("topk_abs_features", """
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) AS top_idx FROM (
  SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY abs(CAST(v AS DOUBLE)) DESC, i) AS r FROM (
    SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))
WHERE r <= 8 GROUP BY vec_id""")
def q_top_abs(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    top = setops.top_abs(F.col("embedding"), 8)
    return e.select("vec_id", F.array_join(F.transform(top, lambda s: s["idx"].cast("string")), ",").alias("top_idx"))


PRED_SQL = """preds AS (SELECT *, CASE WHEN p_xgb >= 0.5 THEN 1 ELSE 0 END AS pred_xgb FROM scored)"""


@query("topk_example_outcomes", with_(TXN, THR, SCORED, PRED_SQL) + """
SELECT outcome, txn_id, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY txn_id) AS rank FROM (
    SELECT txn_id, CASE WHEN label = 1 AND pred_xgb = 1 THEN 'TP' WHEN label = 1 AND pred_xgb = 0 THEN 'FN'
                        WHEN label = 0 AND pred_xgb = 1 THEN 'FP' END AS outcome FROM preds) WHERE outcome IS NOT NULL)
WHERE rank <= 5""")
def q_examples(spark, sf_dir):
    s = scored_txn(spark, sf_dir).withColumn("pred_xgb", (F.col("p_xgb") >= 0.5).cast("int"))
    return metrics.ranked_examples(s, "label", "pred_xgb", ["txn_id"], 5).select("outcome", "txn_id", "rank")


# ---------------------------------------------------------------- processed payload snapshot
KEEP_NUM = ["num__Amount", "num__txn_count_60m"]


def processed_embedding_payload(spark, sf_dir):
    """Embeddings as processed payloads: num__V1..V28 from the first 28
    components, num__Amount / num__txn_count_60m from the label, and a
    one-hot ``cat__label_<n>`` group."""
    e = read_table(spark, sf_dir, "embeddings")
    kv = [x for i in range(28) for x in (F.lit(f"num__V{i + 1}"), F.col("embedding")[i].cast("double"))]
    kv += [F.lit("num__Amount"), (F.col("label") * 10.0), F.lit("num__txn_count_60m"), F.col("label").cast("double")]
    kv += [x for n in range(10) for x in (F.lit(f"cat__label_{n}"), (F.col("label") == n).cast("double"))]
    return e.select("vec_id", F.create_map(*kv).alias("features"))


@query("proj_payload_min_processed", """
, vs AS (SELECT vec_id, i, CAST(v AS DOUBLE) AS v FROM (
    SELECT vec_id, unnest(embedding[1:28]) AS v, unnest(range(1, 29)) AS i FROM embeddings)),
top AS (SELECT vec_id, string_agg('num__V' || CAST(i AS VARCHAR), ',' ORDER BY r) AS top_v FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS r FROM vs) WHERE r <= 8 GROUP BY vec_id)
SELECT e.vec_id, 'processed_102_min_v1' AS _schema, e.label * 10.0 AS num__Amount, CAST(e.label AS DOUBLE) AS num__txn_count_60m,
       top.top_v, 'cat__label_' || CAST(e.label AS VARCHAR) AS cat_flags_on
FROM embeddings e JOIN top USING (vec_id)""".replace("\n, vs AS", "WITH vs AS", 1))
def q_payload_min_processed(spark, sf_dir):
    from txnguard.functions import scalar
    p = processed_embedding_payload(spark, sf_dir)
    m = F.col("features")
    v_entries = F.filter(F.map_entries(m), lambda e: e["key"].startswith("num__V"))
    srt = F.array_sort(v_entries, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                       .when(F.abs(a["value"]) < F.abs(b["value"]), 1)
                       .when(F.length(a["key"]) < F.length(b["key"]), -1)
                       .when(F.length(a["key"]) > F.length(b["key"]), 1)
                       .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
    top_v = F.array_join(F.transform(F.slice(srt, 1, 8), lambda e: e["key"]), ",")
    return p.select("vec_id", F.lit("processed_102_min_v1").alias("_schema"),
                    *[F.element_at(m, k).alias(k) for k in KEEP_NUM], top_v.alias("top_v"),
                    F.array_join(scalar.active_flags(m), ",").alias("cat_flags_on"))
