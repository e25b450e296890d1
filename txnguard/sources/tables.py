"""Table scans and the bindings from reference concepts to the test tables.

A *transaction* is an ``events`` row: txn_id = event_id, device_id = user_id,
amount = value, label = 1 for ``event_type = 'error'``.  The velocity clock
``t`` is epoch seconds integer-divided by 144 (compresses one day into 600
units so that 5/30/60-minute windows hold several rows per device).
Before any model exists, ``p_xgb = k / 100`` with ``k`` from the JSON props
and the anomaly error ``ae_err`` is ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Compression of the event clock and the default score cut-offs.
TIME_COMPRESSION = 144
XGB_T_LOW = 0.05
XGB_T_HIGH = 0.80
AE_REVIEW_Q = 0.95
AE_BLOCK_Q = 0.995


def idiv(a: Column, b: Column) -> Column:
    """Floor integer division of longs (exact, no double rounding)."""
    return ((a - F.pmod(a, b)) / b).cast("long")


def epoch_seconds(ts: Column) -> Column:
    """Whole epoch seconds of a timestamp, taken from the millisecond-rounded
    value: stored timestamps may carry sub-microsecond digits, which readers
    truncate or round differently; rounding to milliseconds first makes the
    second boundary reader-independent."""
    ms = F.round(F.unix_micros(ts) / 1000.0).cast("long")
    return idiv(ms, F.lit(1000))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def utc_ts(col: str | Column) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP (session time zone is UTC)."""
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("timestamp")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions bound to the ``events`` table (see module doc)."""
    ev = read_table(spark, sf_dir, "events")
    ts = utc_ts("ts")
    epoch = epoch_seconds(ts)
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        F.col("event_id").alias("txn_id"),
        F.col("user_id").alias("device_id"),
        ts.alias("ts"),
        epoch.alias("epoch_s"),
        idiv(epoch.cast("long"), F.lit(TIME_COMPRESSION)).alias("t"),
        F.col("value").alias("amount"),
        k.alias("k"),
        F.col("event_type"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
        (k.cast("double") / F.lit(100.0)).alias("p_xgb"),
        F.col("value").alias("ae_err"),
    )


def country_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country centroid dimension derived from ``nation``.

    lat = 5 * key - 60, lon = 14 * key - 170 (25 rows; the size is bounded
    by the nation table, which is why it may be broadcast).
    """
    n = read_table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_nationkey").alias("country_key"),
        F.col("n_name").alias("country"),
        (F.col("n_nationkey") * 5 - 60).cast("double").alias("lat"),
        (F.col("n_nationkey") * 14 - 170).cast("double").alias("lon"),
    )


def txn_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with billing (customer nation) and shipping (k % 25) keys."""
    cust = read_table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("device_id"), F.col("c_nationkey").alias("billing_key"))
    return (txn(spark, sf_dir)
            .join(cust, "device_id", "left")
            .withColumn("shipping_key", F.pmod(F.col("k"), F.lit(25))))
