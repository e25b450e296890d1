"""Queries for data-quality checks, projections and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.functions import scalar
from txnguard.operators import quality, windows
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.plans.bindings import CHECKOUT_SQL, FEAT_SQL, checkout, features_txn
from txnguard.sources.tables import XGB_T_HIGH, XGB_T_LOW, read_table, txn

FEAT = with_(TXN, FEAT_SQL)
CHK = with_(TXN, FEAT_SQL, CHECKOUT_SQL)

KEY_COLS = ["txn_id", "device_id", "ts", "amount", "label", "billing_country", "shipping_country"]


@query("dq_missing_key_columns", FEAT + """
, a AS (SELECT count(*) FILTER (WHERE txn_id IS NULL) AS c1, count(*) FILTER (WHERE device_id IS NULL) AS c2,
               count(*) FILTER (WHERE ts IS NULL) AS c3, count(*) FILTER (WHERE amount IS NULL OR isnan(amount)) AS c4,
               count(*) FILTER (WHERE label IS NULL) AS c5, count(*) FILTER (WHERE billing_country IS NULL) AS c6,
               count(*) FILTER (WHERE shipping_country IS NULL) AS c7 FROM feat)
SELECT "column", n_missing, n_missing = 0 AS passed FROM (
  SELECT 'txn_id' AS "column", c1 AS n_missing FROM a UNION ALL SELECT 'device_id', c2 FROM a
  UNION ALL SELECT 'ts', c3 FROM a UNION ALL SELECT 'amount', c4 FROM a UNION ALL SELECT 'label', c5 FROM a
  UNION ALL SELECT 'billing_country', c6 FROM a UNION ALL SELECT 'shipping_country', c7 FROM a)""")
def q_missing_keys(spark, sf_dir):
    return quality.missing_key_columns(features_txn(spark, sf_dir, []), KEY_COLS)


@query("dq_value_ranges", FEAT + """
, a AS (SELECT count(*) FILTER (WHERE NOT coalesce(amount >= 0, true)) AS c1,
               count(*) FILTER (WHERE NOT coalesce(p_xgb BETWEEN 0 AND 1, true)) AS c2,
               count(*) FILTER (WHERE NOT coalesce(geo_distance_km >= 0, true)) AS c3,
               count(*) FILTER (WHERE NOT coalesce(txn_count_60m >= 1, true)) AS c4,
               count(*) FILTER (WHERE NOT coalesce(label IN (0, 1), true)) AS c5,
               count(*) FILTER (WHERE NOT coalesce(amount < 400, true)) AS c6 FROM feat)
SELECT "check", n_violations, n_violations = 0 AS passed FROM (
  SELECT 'amount_nonnegative' AS "check", c1 AS n_violations FROM a UNION ALL SELECT 'score_in_unit_range', c2 FROM a
  UNION ALL SELECT 'distance_nonnegative', c3 FROM a UNION ALL SELECT 'velocity_at_least_one', c4 FROM a
  UNION ALL SELECT 'label_binary', c5 FROM a UNION ALL SELECT 'amount_below_400', c6 FROM a)""")
def q_value_ranges(spark, sf_dir):
    c = F.col
    return quality.value_ranges(features_txn(spark, sf_dir, ["txn_count_60m"]), {
        "amount_nonnegative": c("amount") >= 0,
        "score_in_unit_range": c("p_xgb").between(0, 1),
        "distance_nonnegative": c("geo_distance_km") >= 0,
        "velocity_at_least_one": c("txn_count_60m") >= 1,
        "label_binary": c("label").isin(0, 1),
        "amount_below_400": c("amount") < 400,
    })


@query("dq_missingness_summary", CHK + """
, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE currency IS NULL) AS c1,
               count(*) FILTER (WHERE country IS NULL) AS c2, count(*) FILTER (WHERE amount IS NULL OR isnan(amount)) AS c3
        FROM chk)
SELECT "column", n_missing, round(CASE WHEN n > 0 THEN n_missing * 100.0 / n ELSE 0 END, 6) AS pct_missing FROM (
  SELECT n, 'currency' AS "column", c1 AS n_missing FROM a UNION ALL SELECT n, 'country', c2 FROM a
  UNION ALL SELECT n, 'amount', c3 FROM a)""")
def q_missingness(spark, sf_dir):
    return quality.missingness_summary(checkout(spark, sf_dir), ["currency", "country", "amount"])


@query("dq_duplicate_rows", with_(TXN) + """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS c FROM txn GROUP BY device_id, event_type, k)""")
def q_dupes(spark, sf_dir):
    return quality.duplicate_rows(txn(spark, sf_dir), ["device_id", "event_type", "k"])


def processed_payload(spark, sf_dir):
    """Processed-feature payload per transaction as a map; the point-in-time
    z-score is absent (not null) for a device's first transaction."""
    t = windows.zscore_point_in_time(txn(spark, sf_dir))
    m = F.map_filter(F.create_map(
        F.lit("num__amount"), F.col("amount"), F.lit("num__p"), F.col("p_xgb"),
        F.lit("num__zscore_pit"), F.col("amount_zscore_pit"),
        F.concat(F.lit("cat__event_type_"), F.col("event_type")), F.lit(1.0)), lambda k, v: v.isNotNull())
    return t.select("txn_id", "device_id", "label", "p_xgb", "event_type", m.alias("features"))


@query("dq_missing_feature_reject", with_(TXN) + """
, z AS (SELECT txn_id, count(*) OVER (PARTITION BY device_id ORDER BY t, txn_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM txn)
SELECT txn_id, prior > 0 AS accepted, CASE WHEN prior > 0 THEN '' ELSE 'num__zscore_pit' END AS missing_features
FROM z""")
def q_missing_feature(spark, sf_dir):
    p = processed_payload(spark, sf_dir)
    r = quality.missing_feature_split(p, "features", ["num__amount", "num__p", "num__zscore_pit"])
    return r.select("txn_id", "accepted", F.array_join("missing_features", ",").alias("missing_features"))


@query("dq_required_checkout_fields", CHK + """
SELECT txn_id, currency IS NOT NULL AS accepted, CASE WHEN currency IS NULL THEN 'currency' ELSE '' END
       AS missing_fields FROM chk""")
def q_required_checkout(spark, sf_dir):
    c = checkout(spark, sf_dir)
    payload = F.struct(F.col("txn_id_s").alias("txn_id"), *[F.col(k) for k in quality.CHECKOUT_REQUIRED[1:]])
    r = quality.required_fields_struct(c.select("txn_id", payload.alias("p")), "p")
    return r.select("txn_id", "accepted", F.array_join("missing_fields", ",").alias("missing_fields"))


@query("dq_required_columns")
def q_required_columns(spark, sf_dir):
    """Schema-only check (rows-only in the driver): required columns absent
    from the features table."""
    f = features_txn(spark, sf_dir)
    return quality.required_columns(spark, f, ["txn_id", "amount", "label", "ip_reputation", "account_age_days"])


@query("dq_dtypes")
def q_dtypes(spark, sf_dir):
    f = features_txn(spark, sf_dir)
    return quality.dtype_mismatches(spark, f, {"txn_id": "int", "amount": "float", "label": "int",
                                               "billing_country": "string", "is_new_device": "bool",
                                               "geo_distance_km": "int", "event_type": "float"})


@query("dq_no_nulls_gate")
def q_no_nulls(spark, sf_dir):
    f = checkout(spark, sf_dir)
    bad = quality.no_nulls_gate(f)
    return spark.createDataFrame([(c,) for c in bad], "column_with_nulls string")


@query("dq_split_schema_equal")
def q_split_schema(spark, sf_dir):
    t = txn(spark, sf_dir)
    split = windows.time_split(t.select("txn_id", "ts", "amount", "label"), ["ts", "txn_id"])
    parts = {s: split.where(F.col("split") == s).drop("split") for s in ("train", "val", "test")}
    ok = quality.split_schema_equal(parts)
    return split.groupBy("split").count().withColumn("schemas_equal", F.lit(ok))


SCHEMA_ORDER = ["txn_id", "label", "amount", "geo_distance_km", "country_mismatch", "txn_count_60m"]


@query("proj_schema_align", FEAT + "SELECT " + ", ".join(SCHEMA_ORDER) + " FROM feat")
def q_schema_align(spark, sf_dir):
    return quality.schema_align(features_txn(spark, sf_dir, SCHEMA_ORDER), SCHEMA_ORDER)


@query("proj_identify_columns")
def q_identify(spark, sf_dir):
    f = features_txn(spark, sf_dir)
    num, cat = quality.identify_columns(f, exclude=("label", "ts", "device_id", "txn_id"))
    rows = [(c, "numeric") for c in num] + [(c, "categorical") for c in cat]
    return spark.createDataFrame(rows, "column string, kind string")


@query("proj_strip_prefix", with_(TXN) + """
SELECT txn_id, amount, CAST(event_type = 'click' AS DOUBLE) AS event_type_click FROM txn""")
def q_strip_prefix(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", F.col("amount").alias("num__amount"),
                                  (F.col("event_type") == "click").cast("double").alias("cat__event_type_click"))
    return quality.strip_prefix(t)


@query("proj_detect_label")
def q_detect_label(spark, sf_dir):
    lab = read_table(spark, sf_dir, "labels")
    name = quality.detect_label(lab, ("Class", "is_fraud", "toxic", "quality"))
    return lab.groupBy(F.col(name).alias("label")).count()


@query("proj_map_features_with_default", FEAT + """
SELECT coalesce(CAST(amount AS DOUBLE), 0.0) AS num__amount, coalesce(CAST(txn_count_60m AS DOUBLE), 0.0) AS num__txn_count_60m,
       0.0 AS num__ip_reputation, coalesce(CAST(geo_distance_km AS DOUBLE), 0.0) AS geo_distance_km FROM feat""")
def q_map_features(spark, sf_dir):
    return quality.map_features_with_default(
        features_txn(spark, sf_dir, ["txn_count_60m"]), ["num__amount", "num__txn_count_60m", "num__ip_reputation", "geo_distance_km"])


@query("proj_numeric_coerce", """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k_num,
       coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS event_type_num FROM events""")
def q_numeric_coerce(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    return ev.select("event_id", scalar.numeric_coerce(F.get_json_object("props", "$.k")).alias("k_num"),
                     scalar.numeric_coerce("event_type").alias("event_type_num"))


CHECKOUT_MIN_FIELDS = ["amount", "country", "ip_country", "currency", "card_currency", "hour", "velocity_1h",
                       "velocity_24h", "is_new_device", "is_proxy_vpn"]


@query("proj_payload_min_checkout", CHK + """
SELECT txn_id_s AS txn_id, txn_id_s AS transaction_id, timestamp, timestamp AS created_at, """
       + ", ".join(CHECKOUT_MIN_FIELDS) + ", 'checkout_min' AS _schema FROM chk")
def q_payload_min_checkout(spark, sf_dir):
    c = checkout(spark, sf_dir)
    s = F.struct(F.col("txn_id_s").alias("txn_id"), F.col("txn_id_s").alias("transaction_id"),
                 F.col("timestamp"), F.col("timestamp").alias("created_at"),
                 *[F.col(k) for k in CHECKOUT_MIN_FIELDS], F.lit("checkout_min").alias("_schema"))
    return c.select(s.alias("payload_min")).select("payload_min.*")


@query("proj_coalesce_ids", """
SELECT event_id, coalesce(nullif(trim(CASE WHEN event_type = 'error' THEN '' ELSE CAST(event_id AS VARCHAR) END), ''),
                          nullif(trim(CAST(user_id AS VARCHAR) || '-' || CAST(event_id AS VARCHAR)), '')) AS txn_id
FROM events""")
def q_coalesce_ids(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    meta_id = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.col("event_id").cast("string"))
    payload_id = F.concat_ws("-", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return ev.select("event_id", scalar.coalesce_truthy(meta_id, payload_id).alias("txn_id"))


@query("filter_legit_only", with_(TXN) + "SELECT txn_id, amount FROM txn WHERE label = 0")
def q_legit(spark, sf_dir):
    return txn(spark, sf_dir).where(F.col("label") == 0).select("txn_id", "amount")


@query("filter_gray_zone", with_(TXN, THR, SCORED) + """
SELECT txn_id, p_xgb, ae_bucket FROM scored WHERE p_xgb >= 0.05 AND p_xgb < 0.8""")
def q_gray(spark, sf_dir):
    from txnguard.operators.policy import in_gray_zone
    s = scored_txn(spark, sf_dir)
    return s.where(in_gray_zone("p_xgb", XGB_T_LOW, XGB_T_HIGH)).select("txn_id", "p_xgb", "ae_bucket")
