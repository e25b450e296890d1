"""Registered queries: operator id -> callable(spark, sf_dir) -> DataFrame.

Each query binds one operator to the test tables (see
``txnguard.sources.tables``) and returns a small, aliased result whose
columns match the DuckDB oracle in ``txnguard.oracles``.  Doubles are
rounded to 6 digits so both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnguard.operators import calibrate, policy, windows
from txnguard.sources.tables import XGB_T_HIGH, XGB_T_LOW, txn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` is its DuckDB SQL (omit when the
    operator is not SQL-expressible)."""
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return fn
    return deco


def r6(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- shared
def scored_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with thresholds, gated anomaly score, bucket and the API
    decision.  The one-row threshold table is cross-joined (broadcast)."""
    t = txn(spark, sf_dir)
    thr = calibrate.percentile_thresholds(t).select(
        F.col("review").alias("ae_review"), F.col("block").alias("ae_block"))
    s = t.crossJoin(F.broadcast(thr))
    gray = policy.in_gray_zone("p_xgb", XGB_T_LOW, XGB_T_HIGH)
    s = s.withColumn("ae_err_g", F.when(gray, F.col("ae_err")))
    s = s.withColumn("ae_bucket", policy.ae_bucket("ae_err_g", "ae_review", "ae_block"))
    return s.select("*", *policy.policy_api("p_xgb", "ae_bucket", XGB_T_LOW, XGB_T_HIGH))


def enriched_txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.enrich(txn(spark, sf_dir))


# ---------------------------------------------------------------- flagship
@query("flagship_enriched_triage")
def q_flagship(spark, sf_dir):
    """Enrich (velocity / rolling / z-score) + thresholds + API policy,
    summarised per decision."""
    s = scored_txn(spark, sf_dir)
    s = windows.zscore_device_agg(windows.velocity_chunked(s))
    agg = s.groupBy("decision").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("label").alias("n_fraud"),
        r6(F.avg("txn_count_60m")).alias("avg_txn_count_60m"),
        r6(F.avg("amount_zscore")).alias("avg_amount_zscore"))
    return agg.withColumn("rate", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


# ---------------------------------------------------------------- windows
@query("win_velocity_inclusive")
def q_vel_incl(spark, sf_dir):
    v = windows.velocity_chunked(txn(spark, sf_dir))
    return v.select("txn_id", *windows.VELOCITY_WINDOWS)


@query("win_velocity_prior")
def q_vel_prior(spark, sf_dir):
    return windows.velocity_prior(txn(spark, sf_dir).select("txn_id", "device_id", "t")).drop("device_id", "t")


@query("win_rolling_mean_50")
def q_roll50(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "device_id", "t", "amount")
    return windows.rolling_mean_chunked(t).select("txn_id", "avg_amount_50")


@query("win_rolling_mean_7d")
def q_roll7d(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "device_id", "epoch_s", "amount")
    return windows.rolling_mean_7d(t).select("txn_id", "avg_amount_7d")


@query("win_zscore_device")
def q_zdev(spark, sf_dir):
    return windows.zscore_device_agg(txn(spark, sf_dir)).select("txn_id", "amount_zscore")


@query("win_zscore_pit")
def q_zpit(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "device_id", "t", "amount")
    return windows.zscore_point_in_time(t).select("txn_id", "amount_zscore_pit")


# ---------------------------------------------------------------- calibration / policy
@query("cal_percentile_thresholds")
def q_cal_pct(spark, sf_dir):
    th = calibrate.percentile_thresholds(txn(spark, sf_dir))
    return th.select(r6(F.col("review")).alias("review"), r6(F.col("block")).alias("block"),
                     "n_legit")


@query("policy_api")
def q_policy_api(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    return s.select("txn_id", "decision", "ae_bucket",
                    F.array_join("reason_codes", ",").alias("reason_codes"))


@query("agg_triage_rates")
def q_triage(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    agg = s.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))
    return agg.withColumn("rate", r6(F.col("n") / F.sum("n").over(Window.partitionBy())))


def load_all() -> None:
    """Import every query module so their ``@query`` registrations run."""
    import importlib
    for mod in ("bind_quality", "bind_aggregates", "bind_metrics", "bind_policy", "bind_functions",
                "bind_joins", "bind_topk", "bind_review", "bind_io", "bind_drift", "bind_ml", "bind_streaming"):
        try:
            importlib.import_module(f"txnguard.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"txnguard.plans.{mod}":
                raise
