"""Readable reasons for a decision, scenario expansion, response records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Reason codes, messages and signal texts of the reason builder.
MSG_HIGH_RISK = ("The predicted fraud probability exceeded the high-risk threshold, "
                 "indicating strong confidence of fraudulent behavior.")
MSG_UNCERTAIN = ("The predicted fraud probability falls within the uncertainty range "
                 "and cannot be confidently approved or blocked.")
MSG_XGB = "The supervised risk model identified the following contributing risk signals:"
MSG_AE = "The anomaly detection model observed deviations from typical legitimate behavior:"
MSG_HUMAN = ("The detected risk signals are inconclusive. Manual review is recommended "
             "to confirm transaction legitimacy and reduce false positives.")
SIG_COUNTRY = "Country mismatch between billing and IP location"
SIG_DEVICE = "New or previously unseen device"
SIG_PROXY = "VPN or proxy usage detected"
SIG_DISTANCE = "Unusually large geographic distance from typical activity"
SIG_VELOCITY = "Elevated transaction velocity within a short time window"
SIG_AMOUNT = "Transaction amount deviates from the user’s historical spending pattern"
SIG_EMBEDDING = "Behavioral embedding features indicate unusual transaction patterns"
SIG_AE_PCT = "Transaction behavior is unusual compared to the majority of legitimate transactions"
SIG_AE_EXTREME = "Behavior is strongly inconsistent with normal legitimate transaction patterns"
DISTANCE_LIMIT = 1.0
VELOCITY_LIMIT = 1.0
ZSCORE_LIMIT = 1.5
EMBEDDING_LIMIT = 2.5
AE_PERCENTILE_LIMIT = 90.0
# ---------------------------------------------------------------------------

_REASON = "struct<code:string,message:string,signals:array<string>>"


def _reason(code: str, msg: str, signals: Column | None = None) -> Column:
    sig = signals if signals is not None else F.lit(None).cast("array<string>")
    return F.struct(F.lit(code).alias("code"), F.lit(msg).alias("message"), sig.alias("signals"))


def reason_details(decision="decision", country_mismatch="f_country_mismatch", new_device="f_new_device",
                   proxy="f_proxy", distance="f_distance", velocity_60m="f_velocity_60m",
                   velocity_30m="f_velocity_30m", zscore="f_zscore", embed=("f_v7", "f_v10", "f_v14"),
                   ae_percentile="ae_percentile", ae_bucket="ae_bucket") -> Column:
    """Ordered reason list (policy, business signals, anomaly signals,
    human-review note) as ``array<struct<code, message, signals>>``.
    Feature inputs are processed-feature values (missing -> 0)."""
    c = F.col
    d = c(decision)

    def v(name):
        return F.coalesce(c(name).cast("double"), F.lit(0.0))
    xgb = F.array_compact(F.array(
        F.when(v(country_mismatch) == 1, F.lit(SIG_COUNTRY)),
        F.when(v(new_device) == 1, F.lit(SIG_DEVICE)),
        F.when(v(proxy) == 1, F.lit(SIG_PROXY)),
        F.when(c(distance).isNotNull() & (v(distance) > DISTANCE_LIMIT), F.lit(SIG_DISTANCE)),
        F.when((v(velocity_60m) > VELOCITY_LIMIT) | (v(velocity_30m) > VELOCITY_LIMIT), F.lit(SIG_VELOCITY)),
        F.when(c(zscore).isNotNull() & (F.abs(v(zscore)) > ZSCORE_LIMIT), F.lit(SIG_AMOUNT)),
        F.when(F.greatest(*[F.abs(v(e)) for e in embed]) > EMBEDDING_LIMIT, F.lit(SIG_EMBEDDING))))
    ae = F.array_compact(F.array(
        F.when(c(ae_percentile).isNotNull() & (c(ae_percentile) > AE_PERCENTILE_LIMIT), F.lit(SIG_AE_PCT)),
        F.when(c(ae_bucket) == "extreme", F.lit(SIG_AE_EXTREME))))
    items = F.array(
        F.when(d == "BLOCK", _reason("HIGH_RISK_SCORE", MSG_HIGH_RISK))
        .when(d == "REVIEW", _reason("UNCERTAIN_RISK_SCORE", MSG_UNCERTAIN)),
        F.when(F.size(xgb) > 0, _reason("XGB_CONTRIBUTING_SIGNALS", MSG_XGB, xgb)),
        F.when(F.size(ae) > 0, _reason("AE_CONTRIBUTING_SIGNALS", MSG_AE, ae)),
        F.when(d == "REVIEW", _reason("HUMAN_REVIEW_RECOMMENDED", MSG_HUMAN)))
    return F.array_compact(items)


def decision_record(decision="decision", payload_hash="payload_hash", review_id="review_id",
                    p="p_xgb", err="ae_err", bucket="ae_bucket", pct="ae_percentile",
                    reasons="reason_details") -> Column:
    """Nested response: decision, request{payload_hash, review_id}, scores{...},
    reason_details (omitted for APPROVE)."""
    c = F.col
    return F.struct(
        c(decision).alias("decision"),
        F.struct(c(payload_hash).alias("payload_hash"), c(review_id).alias("review_id")).alias("request"),
        F.struct(c(p).cast("double").alias("xgb_probability"), c(err).cast("double").alias("ae_error"),
                 c(bucket).alias("ae_bucket"), c(pct).cast("double").alias("ae_percentile_vs_legit")).alias("scores"),
        F.when(c(decision) != "APPROVE", c(reasons)).alias("reason_details"))


def scenario_expansion(base: DataFrame, templates: DataFrame, rescore, keep: Column,
                       key: str, limit_per_template: int | None = None) -> DataFrame:
    """Rows x what-if templates (broadcast; the template list is a fixed
    config), rescored by ``rescore(df)``, filtered by ``keep`` (e.g. "still
    in the review band").  ``limit_per_template`` keeps the first n per
    template by key -- the limit is the feature of the operator."""
    from pyspark.sql import Window
    x = base.crossJoin(F.broadcast(templates))
    scored = rescore(x).where(keep)
    if limit_per_template is None:
        return scored
    w = Window.partitionBy("template").orderBy(key)
    return scored.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= limit_per_template).drop("__rn")
