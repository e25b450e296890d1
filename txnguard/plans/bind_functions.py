"""Queries for scalar functions and the order-based checkout
binding (new device, attempts today, checkout heuristics)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.functions import scalar
from txnguard.operators import aggregates as A
from txnguard.operators import windows
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.plans.bindings import CHECKOUT_SQL, FEAT_SQL, checkout, features_txn
from txnguard.sources.tables import read_table, txn

FEAT = with_(TXN, FEAT_SQL)
CHK = with_(TXN, FEAT_SQL, CHECKOUT_SQL)
SC = with_(TXN, THR, SCORED)


@query("fn_haversine", FEAT + """
SELECT txn_id, round_even(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat_s) - radians(lat_b)) / 2), 2)
      + cos(radians(lat_b)) * cos(radians(lat_s)) * pow(sin((radians(lon_s) - radians(lon_b)) / 2), 2))), 1)
      AS geo_distance_km FROM feat""")
def q_haversine(spark, sf_dir):
    return features_txn(spark, sf_dir, []).select(
        "txn_id", scalar.haversine_km("lat_b", "lon_b", "lat_s", "lon_s").alias("geo_distance_km"))


REL_SQL = "rel AS (SELECT *, epoch_s - min(epoch_s) OVER () AS time_s FROM txn)"


def _rel(spark, sf_dir):
    t = txn(spark, sf_dir)
    t0 = t.agg(F.min("epoch_s").alias("__t0"))
    return t.crossJoin(F.broadcast(t0)).withColumn("time_s", F.col("epoch_s") - F.col("__t0")).drop("__t0")


@query("fn_device_id_lcg", with_(TXN, REL_SQL) + """
SELECT txn_id, 'dev_' || CAST(((time_s * 1103515245 + 12345) % 2000000 + 2000000) % 2000000 AS VARCHAR) AS device_key
FROM rel""")
def q_lcg(spark, sf_dir):
    return _rel(spark, sf_dir).select("txn_id", scalar.device_id_lcg("time_s").alias("device_key"))


@query("fn_epoch_anchor", with_(TXN, REL_SQL) + """
SELECT txn_id, strftime(TIMESTAMP '2013-09-01 00:00:00' + to_seconds(time_s), '%Y-%m-%d %H:%M:%S') AS anchored_ts,
       CAST(epoch(TIMESTAMP '2013-09-01 00:00:00') AS BIGINT) + time_s AS anchored_epoch FROM rel""")
def q_anchor(spark, sf_dir):
    r = _rel(spark, sf_dir).withColumn("a", scalar.epoch_anchor("time_s"))
    return r.select("txn_id", F.date_format("a", "yyyy-MM-dd HH:mm:ss").alias("anchored_ts"),
                    F.unix_timestamp("a").alias("anchored_epoch"))


@query("fn_night_weekend", with_(TXN) + """
SELECT txn_id, hour(ts) IN (0, 1, 2, 3, 4, 5, 23) AS night_txn, hour(ts) IN (0, 1, 2, 3, 4, 5) AS night_rule,
       isodow(ts) IN (6, 7) AS weekend_txn FROM txn""")
def q_night(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t.select("txn_id", scalar.night_flag("ts").alias("night_txn"),
                    scalar.night_flag("ts", scalar.RULE_NIGHT_HOURS).alias("night_rule"),
                    scalar.weekend_flag("ts").alias("weekend_txn"))


@query("fn_country_mismatch", CHK + """, j AS (SELECT c.*, f.billing_country, f.shipping_country FROM chk c JOIN feat f USING (txn_id))
SELECT txn_id, billing_country <> shipping_country AS country_mismatch,
       coalesce(currency <> card_currency AND currency IS NOT NULL AND card_currency IS NOT NULL, false) AS currency_mismatch
FROM j""")
def q_mismatch(spark, sf_dir):
    c = checkout(spark, sf_dir)
    f = features_txn(spark, sf_dir, []).select("txn_id", "billing_country", "shipping_country")
    j = c.join(f, "txn_id")
    return j.select("txn_id", scalar.country_mismatch("billing_country", "shipping_country").alias("country_mismatch"),
                    scalar.country_mismatch("currency", "card_currency", null_safe=True).alias("currency_mismatch"))


# ---------------------------------------------------------------- order checkout binding
def order_checkout(spark, sf_dir):
    """Orders as checkouts: customer = account, first order = new device,
    same-day orders = attempts, status/priority drive AVS/CVV/shipping."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    o = o.withColumn("order_ts", F.col("o_orderdate").cast("timestamp"))
    o = o.join(c, o.o_custkey == c.c_custkey, "left").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    first = F.min("order_ts").over(Window.partitionBy("o_custkey"))
    o = windows.new_device_flag(o, "o_custkey", "order_ts", "o_orderkey")
    o = windows.attempts_today(o, "o_custkey", "order_ts", "o_orderkey")
    ship = (F.when(F.col("o_orderpriority") == "1-URGENT", "Express").when(F.col("o_orderpriority") == "2-HIGH", "Next-Day")
            .otherwise("Standard"))
    return o.select(
        "o_orderkey", "o_custkey", "is_new_device", "attempts_today", "rapid_retry",
        F.datediff(F.col("order_ts"), first).alias("account_age_days"),
        (F.col("o_totalprice") / 1000.0).alias("amount"),
        F.col("n_name").alias("shipping_country"), F.col("n_name").alias("card_country"),
        F.when(F.col("o_orderstatus") == "F", "N").otherwise("Y").alias("avs_result"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "N").otherwise("Y").alias("cvv_result"),
        F.pmod(F.col("o_orderkey"), F.lit(24)).cast("int").alias("hour"),
        (F.col("c_mktsegment") == "HOUSEHOLD").alias("is_guest"), ship.alias("shipping_method"))


ORD_SQL = """ord0 AS (
  SELECT o.*, CAST(o_orderdate AS TIMESTAMP) AS order_ts, c.c_nationkey, c.c_mktsegment, n.n_name
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
ord AS (
  SELECT o_orderkey, o_custkey,
    row_number() OVER (PARTITION BY o_custkey ORDER BY order_ts, o_orderkey) = 1 AS is_new_device,
    count(*) OVER (PARTITION BY o_custkey, CAST(order_ts AS DATE) ORDER BY order_ts, o_orderkey
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS attempts_today,
    date_diff('day', min(order_ts) OVER (PARTITION BY o_custkey), order_ts) AS account_age_days,
    o_totalprice / 1000.0 AS amount, n_name AS shipping_country, n_name AS card_country,
    CASE WHEN o_orderstatus = 'F' THEN 'N' ELSE 'Y' END AS avs_result,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'N' ELSE 'Y' END AS cvv_result,
    CAST(o_orderkey % 24 AS INTEGER) AS hour, c_mktsegment = 'HOUSEHOLD' AS is_guest,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'Express' WHEN o_orderpriority = '2-HIGH' THEN 'Next-Day'
         ELSE 'Standard' END AS shipping_method
  FROM ord0)"""


@query("fn_checkout_flags", with_(ORD_SQL) + """
SELECT o_orderkey, account_age_days < 30 AND amount > 300.0 AS flag_new_high_value_acc,
  shipping_country <> 'NATION_0' AS flag_address_mismatch, coalesce(avs_result = 'N', false) AS flag_avs_failed,
  coalesce(cvv_result = 'N', false) AS flag_cvv_failed, hour < 5 AS flag_odd_hour, attempts_today > 3 AS flag_rapid_retries,
  is_guest AND is_new_device AS flag_guest_new_device,
  amount > 250.0 AND shipping_method IN ('Express', 'Next-Day') AS flag_express_high_value,
  card_country <> 'NATION_0' AS flag_geo_mismatch FROM ord""")
def q_checkout_flags(spark, sf_dir):
    # the binding's home country is nation 0 (the generator's literal home is absent from the tables)
    return order_checkout(spark, sf_dir).select("o_orderkey", *scalar.checkout_flags(home_country="NATION_0"))


@query("win_new_device", with_(ORD_SQL) + "SELECT o_orderkey, is_new_device FROM ord")
def q_new_device(spark, sf_dir):
    return order_checkout(spark, sf_dir).select("o_orderkey", "is_new_device")


@query("win_attempts_today", with_(ORD_SQL) + """
SELECT o_orderkey, attempts_today, attempts_today > 3 AS rapid_retry FROM ord""")
def q_attempts(spark, sf_dir):
    return order_checkout(spark, sf_dir).select("o_orderkey", "attempts_today", "rapid_retry")


# ---------------------------------------------------------------- payload functions
PAYLOAD_TEXT = """'cat__event_type_' || event_type || '=1.000000|num__amount=' || CAST(CAST(amount AS DECIMAL(18, 6)) AS VARCHAR)
    || '|num__p=' || CAST(CAST(p_xgb AS DECIMAL(18, 6)) AS VARCHAR)"""


def _payload(t, reverse=False):
    pairs = [(F.lit("num__p"), F.col("p_xgb")), (F.lit("num__amount"), F.col("amount")),
             (F.concat(F.lit("cat__event_type_"), F.col("event_type")), F.lit(1.0))]
    pairs = [(k, v.cast("decimal(18,6)")) for k, v in pairs]  # exact here, and printed alike by every engine
    if reverse:
        pairs = pairs[::-1]
    return F.create_map(*[x for kv in pairs for x in kv])


@query("fn_payload_hash", with_(TXN) + f"""
SELECT txn_id, sha256({PAYLOAD_TEXT}) AS payload_hash, true AS order_independent FROM txn""")
def q_payload_hash(spark, sf_dir):
    t = txn(spark, sf_dir)
    a = scalar.payload_hash(_payload(t))
    b = scalar.payload_hash(_payload(t, reverse=True))
    return t.select("txn_id", a.alias("payload_hash"), (a == b).alias("order_independent"))


@query("fn_review_id", with_(TXN) + f"""
SELECT txn_id, 'rev_' || substr(sha256({PAYLOAD_TEXT}), 1, 16) AS review_id FROM txn""")
def q_review_id(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t.select("txn_id", scalar.review_id(scalar.payload_hash(_payload(t))).alias("review_id"))


VERSION_RAW_SQL = """vr AS (SELECT txn_id, CASE event_type WHEN 'click' THEN '   ' WHEN 'view' THEN 'Unknown'
    WHEN 'error' THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 'purchase' THEN 'xgb feedback 2024w' || CAST(week(ts) AS VARCHAR)
    ELSE '--v' || CAST(k AS VARCHAR) || '/beta--' END AS raw FROM txn)"""


def _version_raw(t):
    return (F.when(F.col("event_type") == "click", F.lit("   ")).when(F.col("event_type") == "view", F.lit("Unknown"))
            .when(F.col("event_type") == "error", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(F.col("event_type") == "purchase", F.concat(F.lit("xgb feedback 2024w"), F.weekofyear("ts").cast("string")))
            .otherwise(F.concat(F.lit("--v"), F.col("k").cast("string"), F.lit("/beta--"))))


NORM_SQL = """CASE WHEN trim(raw) = '' THEN 'v1' WHEN lower(trim(raw)) IN ('legacy-unknown', 'unknown', 'n/a', 'none') THEN 'v1'
     WHEN regexp_matches(trim(raw), '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?Z$') THEN 'v1'
     WHEN regexp_replace(regexp_replace(trim(raw), '[^a-zA-Z0-9._\\-]+', '-', 'g'), '^-+|-+$', '', 'g') = '' THEN 'v1'
     ELSE regexp_replace(regexp_replace(trim(raw), '[^a-zA-Z0-9._\\-]+', '-', 'g'), '^-+|-+$', '', 'g') END"""


@query("fn_normalize_model_version", with_(TXN, VERSION_RAW_SQL) + f"SELECT txn_id, {NORM_SQL} AS model_version FROM vr")
def q_norm_version(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t.select("txn_id", scalar.normalize_model_version(_version_raw(t)).alias("model_version"))


@query("fn_validate_model_version", with_(TXN, VERSION_RAW_SQL) + f"""
SELECT txn_id, v = 'v1' OR starts_with(v, 'xgb-') AS valid FROM (SELECT txn_id, {NORM_SQL} AS v FROM vr)""")
def q_valid_version(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t.select("txn_id", scalar.valid_model_version(scalar.normalize_model_version(_version_raw(t))).alias("valid"))


CATEGORY_SQL = """CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'safe_browse' WHEN 'error' THEN 'block_fraud'
                  WHEN 'purchase' THEN 'review' ELSE 'new_signup' END"""


@query("fn_canonical_decision", with_(TXN) + f"""
, c AS (SELECT txn_id, lower(coalesce({CATEGORY_SQL}, 'none')) AS c FROM txn)
SELECT txn_id, CASE WHEN c IN ('approve', 'safe') THEN 'APPROVE' WHEN c IN ('block_fraud', 'risky') THEN 'BLOCK'
  WHEN c IN ('gray', 'review_legit', 'review') THEN 'REVIEW' WHEN contains(c, 'block') OR contains(c, 'fraud') THEN 'BLOCK'
  WHEN contains(c, 'approve') OR contains(c, 'safe') THEN 'APPROVE' ELSE 'REVIEW' END AS canonical FROM c""")
def q_canonical(spark, sf_dir):
    t = txn(spark, sf_dir)
    cat = (F.when(F.col("event_type") == "click", "approve").when(F.col("event_type") == "view", "safe_browse")
           .when(F.col("event_type") == "error", "block_fraud").when(F.col("event_type") == "purchase", "review")
           .otherwise("new_signup"))
    return t.select("txn_id", scalar.canonical_decision(cat).alias("canonical"))


@query("fn_outcome_label", SC + """
SELECT txn_id, CASE upper(trim(' ' || lower(decision) || ' ')) WHEN 'BLOCK' THEN 1 WHEN 'APPROVE' THEN 0 END AS outcome
FROM scored""")
def q_outcome(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    raw = F.concat(F.lit(" "), F.lower("decision"), F.lit(" "))
    return s.select("txn_id", scalar.outcome_label(raw).alias("outcome"))


@query("fn_payload_kind", with_(TXN) + """
SELECT txn_id, CASE WHEN event_type IN ('view', 'click') THEN 'processed' ELSE 'checkout' END AS kind FROM txn""")
def q_payload_kind(spark, sf_dir):
    t = txn(spark, sf_dir)
    m = F.when(F.col("event_type").isin("view", "click"),
               F.create_map(F.lit("num__amount"), F.col("amount"), F.lit("cat__x_1"), F.lit(1.0))) \
        .otherwise(F.create_map(F.lit("num__amount"), F.col("amount"), F.lit("amount"), F.col("amount")))
    return t.select("txn_id", scalar.payload_kind(m).alias("kind"))


ACTIVE = ["is_new_device", "is_proxy_vpn", "country_mismatch", "night_txn", "weekend_txn"]


@query("fn_active_flags", FEAT + "SELECT txn_id, concat_ws(',', " + ", ".join(
    f"CASE WHEN {f} THEN 'cat__{f}_True' END" for f in ACTIVE) + ") AS active_flags FROM feat")
def q_active_flags(spark, sf_dir):
    f = features_txn(spark, sf_dir, ACTIVE)
    m = F.create_map(F.lit("num__amount"), F.col("amount"),
                     *[x for a in ACTIVE for x in (F.lit(f"cat__{a}_True"), F.col(a).cast("double"))])
    return f.select("txn_id", F.array_join(scalar.active_flags(m), ",").alias("active_flags"))


@query("fn_parse_json_columns", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n_codes,
       CASE WHEN event_type = 'error' THEN '' ELSE event_type END AS codes FROM events""")
def q_parse_json(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    codes_txt = F.when(F.col("event_type") != "error", F.concat(F.lit('["'), F.col("event_type"), F.lit('"]')))
    props = F.from_json("props", "map<string,int>")
    codes = F.coalesce(F.from_json(codes_txt, "array<string>"), F.array().cast("array<string>"))
    return ev.select("event_id", F.element_at(props, "k").alias("k"), F.size(codes).alias("n_codes"),
                     F.array_join(codes, ",").alias("codes"))


@query("fn_null_display_defaults", SC + """
SELECT txn_id, coalesce(CASE WHEN ae_err_g IS NOT NULL THEN p_xgb END, 0.5) AS score_xgb,
       coalesce(CASE WHEN ae_err_g IS NOT NULL THEN ae_bucket END, 'unknown') AS ae_bucket,
       coalesce(round(ae_err_g / 10.0, 6), 0.0) AS ae_percentile_vs_legit FROM scored""")
def q_null_defaults(spark, sf_dir):
    s = scored_txn(spark, sf_dir).select(
        "txn_id", F.when(F.col("ae_err_g").isNotNull(), F.col("p_xgb")).alias("score_xgb"),
        F.when(F.col("ae_err_g").isNotNull(), F.col("ae_bucket")).alias("ae_bucket"),
        A.r6(F.col("ae_err_g") / 10.0).alias("ae_percentile_vs_legit"))
    return s.select("txn_id", *scalar.null_display_defaults())


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@query("fn_onehot_override", with_(TXN) + """
SELECT txn_id, 1.0 AS flag_sum, 1.0 AS chosen_value,
       CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END AS original_value FROM txn""")
def q_onehot(spark, sf_dir):
    t = txn(spark, sf_dir)
    m = F.create_map(*[x for e in EVENT_TYPES
                       for x in (F.lit(f"cat__event_type_{e}"), (F.col("event_type") == e).cast("double"))])
    o = scalar.onehot_override(m, "cat__event_type_", "cat__event_type_error")
    return t.select("txn_id", F.aggregate(F.map_values(o), F.lit(0.0), lambda a, v: a + v).alias("flag_sum"),
                    F.element_at(o, "cat__event_type_error").alias("chosen_value"),
                    F.element_at(m, "cat__event_type_error").alias("original_value"))


@query("fn_clip_boost", with_(TXN) + """
SELECT txn_id, round_even(greatest(0.0, least(1.0, p_xgb + ((k % 7) / 10.0) * CAST(label AS DOUBLE))), 3) AS ip_reputation
FROM txn""")
def q_clip_boost(spark, sf_dir):
    t = txn(spark, sf_dir)
    return t.select("txn_id", scalar.clip_boost("p_xgb", F.pmod(F.col("k"), F.lit(7)) / 10.0, "label")
                    .alias("ip_reputation"))


@query("fn_minmax_scale", with_(TXN) + """
, mm AS (SELECT min(amount) AS lo, max(amount) AS hi FROM txn)
SELECT txn_id, round(CASE WHEN hi > lo THEN (amount - lo) / (hi - lo) ELSE 0.0 END, 6) AS amount_scaled FROM txn, mm""")
def q_minmax(spark, sf_dir):
    t = txn(spark, sf_dir)
    mm = t.agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"))
    return t.crossJoin(F.broadcast(mm)).select(
        "txn_id", A.r6(scalar.minmax_scale("amount", "lo", "hi")).alias("amount_scaled"))


FEATURE_IDS_SQL = """ids AS (
  SELECT DISTINCT 'cat__billing_country_' || n_name AS feature FROM nation
  UNION SELECT DISTINCT 'cat__device_os_' || event_type FROM events
  UNION SELECT 'num__V' || CAST(label AS VARCHAR) FROM embeddings
  UNION SELECT 'num__' || c FROM (VALUES ('txn_count_60m'), ('amount_zscore'), ('Amount'), ('k')) v(c)
  UNION SELECT 'cat__' || c || '_True' FROM (VALUES ('is_proxy_vpn'), ('night_txn'), ('event_type')) v(c))"""


def _feature_ids(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation").select(F.concat(F.lit("cat__billing_country_"), "n_name").alias("feature"))
    e = read_table(spark, sf_dir, "events").select(F.concat(F.lit("cat__device_os_"), "event_type").alias("feature"))
    v = read_table(spark, sf_dir, "embeddings").select(F.concat(F.lit("num__V"), F.col("label").cast("string")).alias("feature"))
    fixed = spark.createDataFrame([(f"num__{c}",) for c in ("txn_count_60m", "amount_zscore", "Amount", "k")]
                                  + [(f"cat__{c}_True",) for c in ("is_proxy_vpn", "night_txn", "event_type")], "feature string")
    return n.unionByName(e).unionByName(v).unionByName(fixed).distinct()


FRIENDLY_SQL = "CASE " + " ".join(f"WHEN feature = '{k}' THEN '{v}'" for k, v in scalar.FRIENDLY_NAMES.items()) + \
    " WHEN starts_with(feature, 'num__V') THEN upper(substr(feature, 6)) " + " ".join(
        f"WHEN starts_with(feature, '{p}') THEN '{lab}' || substr(feature, {len(p) + 1})"
        for p, lab in scalar.FRIENDLY_PREFIXES) + " ELSE feature END"


@query("fn_friendly_feature_name", with_(FEATURE_IDS_SQL) + f"SELECT feature, {FRIENDLY_SQL} AS label FROM ids")
def q_friendly(spark, sf_dir):
    ids = _feature_ids(spark, sf_dir)
    return ids.select("feature", scalar.friendly_feature_name("feature").alias("label"))
