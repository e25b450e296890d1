"""Shared test-table bindings (Spark) and their DuckDB CTE twins.

``features_txn`` is the analogue of the reference's enriched transaction
table: transactions + geo (customer nation = billing, k % 25 = shipping)
+ time flags + device windows.  ``requests`` reads the same events as a
request log (latency = value, status from the event type) for the
latency / load-run operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnguard.functions import scalar
from txnguard.operators import windows
from txnguard.plans.prefix import range_sums
from txnguard.sources.tables import country_dim, read_table, txn

# Fixed values of the binding: proxy flag when k >= 90.
PROXY_K = 90


def features_txn(spark: SparkSession, sf_dir: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """All features, or of the device features only those in ``wanted``."""
    t = windows.enrich(txn(spark, sf_dir), wanted)
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("billing_key"))
    dim = country_dim(spark, sf_dir)  # one row per nation: bounded by the nation table
    b = dim.select(F.col("country_key").alias("billing_key"), F.col("country").alias("billing_country"),
                   F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    s = dim.select(F.col("country_key").alias("shipping_key"), F.col("country").alias("shipping_country"),
                   F.col("lat").alias("lat_s"), F.col("lon").alias("lon_s"))
    df = (t.join(cust, "device_id", "left")
          .withColumn("shipping_key", F.pmod(F.col("k"), F.lit(25)))
          .join(F.broadcast(b), "billing_key", "left")
          .join(F.broadcast(s), "shipping_key", "left"))
    return df.select(
        "*",
        scalar.haversine_km("lat_b", "lon_b", "lat_s", "lon_s").alias("geo_distance_km"),
        scalar.country_mismatch("billing_country", "shipping_country").alias("country_mismatch"),
        scalar.night_flag("ts").alias("night_txn"),
        scalar.weekend_flag("ts").alias("weekend_txn"),
        (F.col("k") >= PROXY_K).alias("is_proxy_vpn"),
    )


FEAT_SQL = """cust AS (SELECT c_custkey AS device_id, c_nationkey AS billing_key FROM customer),
dim AS (SELECT n_nationkey AS country_key, n_name AS country, CAST(n_nationkey * 5 - 60 AS DOUBLE) AS lat,
               CAST(n_nationkey * 14 - 170 AS DOUBLE) AS lon FROM nation),
feat0 AS (
  SELECT txn.*, cust.billing_key, txn.k % 25 AS shipping_key,
         b.country AS billing_country, b.lat AS lat_b, b.lon AS lon_b,
         s.country AS shipping_country, s.lat AS lat_s, s.lon AS lon_s
  FROM txn LEFT JOIN cust USING (device_id)
  LEFT JOIN dim b ON b.country_key = cust.billing_key
  LEFT JOIN dim s ON s.country_key = txn.k % 25),
feat AS (
  SELECT *,
    round_even(2 * 6371.0 * asin(sqrt(pow(sin((radians(lat_s) - radians(lat_b)) / 2), 2)
      + cos(radians(lat_b)) * cos(radians(lat_s)) * pow(sin((radians(lon_s) - radians(lon_b)) / 2), 2))), 1)
      AS geo_distance_km,
    billing_country <> shipping_country AS country_mismatch,
    hour(ts) IN (0, 1, 2, 3, 4, 5, 23) AS night_txn,
    isodow(ts) IN (6, 7) AS weekend_txn,
    row_number() OVER (PARTITION BY device_id ORDER BY t, txn_id) = 1 AS is_new_device,
    k >= 90 AS is_proxy_vpn,
    row_number() OVER (PARTITION BY device_id ORDER BY t, txn_id)
      - count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 301 PRECEDING)
      AS txn_count_5m,
    row_number() OVER (PARTITION BY device_id ORDER BY t, txn_id)
      - count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1801 PRECEDING)
      AS txn_count_30m,
    row_number() OVER (PARTITION BY device_id ORDER BY t, txn_id)
      - count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING)
      AS txn_count_60m,
    round_even(CAST(sum(round(amount * 100)) OVER (PARTITION BY device_id ORDER BY t, txn_id
      ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(amount) OVER (PARTITION BY device_id
      ORDER BY t, txn_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) / 100.0 AS avg_amount_50,
    round_even((amount - avg(amount) OVER (PARTITION BY device_id))
      / (stddev_pop(amount) OVER (PARTITION BY device_id) + 1e-9), 3) + 0.0 AS amount_zscore
  FROM feat0)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log view of ``events``: latency_ms = value, status 500 for
    errors, 404 for signups, else 200; run = UTC day."""
    ev = read_table(spark, sf_dir, "events")
    status = (F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404)
              .otherwise(200))
    return ev.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"),
                     F.col("value").alias("latency_ms"), status.alias("status_code"),
                     (status < 400).alias("ok"), F.to_date(F.col("ts").cast("timestamp")).alias("run_id"),
                     F.col("user_id"))


REQ_SQL = """req AS (
  SELECT event_id AS request_id, ts, value AS latency_ms,
         CASE WHEN event_type = 'error' THEN 500 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS status_code,
         event_type NOT IN ('error', 'signup') AS ok, CAST(ts AS DATE) AS run_id, user_id
  FROM events)"""


def checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkout payload view of the features: amount doubled into the
    rule's range, currencies from the nation keys (billing nations with
    key % 5 = 0 carry no currency, to exercise missing fields), 24-hour
    velocity from a true 24-hour RANGE window on epoch seconds."""
    f = features_txn(spark, sf_dir, ["is_new_device", "txn_count_60m"])
    day = range_sums(txn(spark, sf_dir).select("txn_id", "device_id", "epoch_s"), ["device_id"], "epoch_s",
                     {"velocity_24h": (F.lit(1).cast("long"), -86399, 0)})
    f = f.join(day.select("txn_id", "velocity_24h"), "txn_id")
    cur = F.when(F.pmod(F.col("billing_key"), F.lit(5)) == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("C"), F.pmod(F.col("billing_key"), F.lit(3)).cast("string")))
    return f.select(
        "txn_id", "device_id", "label", "p_xgb", "ae_err",
        F.col("txn_id").cast("string").alias("txn_id_s"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        (F.col("amount") * 2).alias("amount"),
        F.col("billing_country").alias("country"), F.col("shipping_country").alias("ip_country"),
        cur.alias("currency"),
        F.concat(F.lit("C"), F.pmod(F.col("shipping_key"), F.lit(3)).cast("string")).alias("card_currency"),
        F.hour("ts").alias("hour"), F.col("txn_count_60m").alias("velocity_1h"),
        "velocity_24h",
        "is_new_device", "is_proxy_vpn")


CHECKOUT_SQL = """chk AS (
  SELECT txn_id, device_id, label, p_xgb, ae_err, CAST(txn_id AS VARCHAR) AS txn_id_s,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, amount * 2 AS amount,
         billing_country AS country, shipping_country AS ip_country,
         CASE WHEN billing_key % 5 = 0 THEN NULL ELSE 'C' || CAST(billing_key % 3 AS VARCHAR) END AS currency,
         'C' || CAST(shipping_key % 3 AS VARCHAR) AS card_currency,
         hour(ts) AS hour, txn_count_60m AS velocity_1h,
         count(*) OVER (PARTITION BY device_id ORDER BY epoch_s RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW)
           AS velocity_24h,
         is_new_device, is_proxy_vpn
  FROM feat)"""
