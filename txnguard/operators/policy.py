"""Decision policies: scores -> APPROVE / REVIEW / BLOCK (+ reason codes).

All policies are ``CASE WHEN`` columns, so they run inside whole-stage
codegen with no shuffle.  Thresholds come either as Python floats or as
columns of a one-row config DataFrame cross-joined with ``F.broadcast``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.functions.scalar import RULE_BLOCK_SCORE, RULE_REVIEW_SCORE, rule_reason_codes, rule_score


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def at_least(x, limit) -> Column:
    """``x >= limit``; never for NaN, which Spark sorts above all numbers."""
    return (_c(x) >= _c(limit)) & ~F.isnan(_c(x).cast("double"))


def ae_bucket(err, review, block) -> Column:
    """``extreme`` (err >= block), ``elevated`` (>= review), ``normal``;
    ``n/a`` when no error was computed."""
    e = _c(err)
    return (F.when(e.isNull(), F.lit("n/a")).when(at_least(e, block), F.lit("extreme"))
            .when(at_least(e, review), F.lit("elevated")).otherwise(F.lit("normal")))


def in_gray_zone(p, t_low, t_high) -> Column:
    return (_c(p) >= _c(t_low)) & (_c(p) < _c(t_high))


def policy_api(p="p_xgb", bucket="ae_bucket", t_low=0.05, t_high=0.80) -> list[Column]:
    """Online policy: p < low APPROVE; p >= high BLOCK; gray zone: an extreme
    anomaly bucket blocks, everything else goes to REVIEW."""
    pc, b = _c(p), _c(bucket)
    decision = (F.when(pc < _c(t_low), "APPROVE").when(at_least(pc, t_high), "BLOCK")
                .when(b == "extreme", "BLOCK").otherwise("REVIEW"))
    codes = (F.when(pc < _c(t_low), F.array().cast("array<string>"))
             .when(at_least(pc, t_high), F.array(F.lit("xgb_high_risk")))
             .otherwise(F.array_compact(F.array(
                 F.lit("xgb_gray_zone"),
                 F.when(b == "extreme", F.lit("ae_block_gate")),
                 F.when(b == "elevated", F.lit("ae_review_gate"))))))
    return [decision.alias("decision"), codes.alias("reason_codes")]


def policy_ae_first(p="p_xgb", err="ae_err", ae_block=None, t_low=0.05, t_high=0.80) -> list[Column]:
    """Offline evaluator: AE gate first, then p >= high, p <= low, else REVIEW."""
    pc, e = _c(p), _c(err)
    gate = e.isNotNull() & (at_least(e, ae_block))
    decision = (F.when(gate, "BLOCK").when(at_least(pc, t_high), "BLOCK")
                .when(pc <= _c(t_low), "APPROVE").otherwise("REVIEW"))
    reason = (F.when(gate, "ae_block_gate").when(at_least(pc, t_high), "xgb_block_high")
              .when(pc <= _c(t_low), "xgb_approve_low").otherwise("xgb_gray_zone"))
    return [decision.alias("decision"), F.array(reason).alias("reason_codes")]


def policy_threshold_only(p="p_xgb", t_low=0.05, t_high=0.80, t_main=0.5) -> Column:
    """Binary: bands, the gray zone decided by the main cut-off."""
    pc = _c(p)
    return (F.when(pc < _c(t_low), 0).when(at_least(pc, t_high), 1)
            .when(at_least(pc, t_main), 1).otherwise(0)).alias("pred")


def policy_hybrid_binary(p="p_xgb", err="ae_err", t_low=0.05, t_high=0.80, ae_threshold=None) -> Column:
    pc = _c(p)
    return (F.when(pc < _c(t_low), 0).when(at_least(pc, t_high), 1)
            .when(at_least(_c(err), ae_threshold), 1).otherwise(0)).alias("pred")


def policy_scaled_band(p="p_xgb", base=0.5, low_factor=0.5, high_factor=1.5) -> Column:
    pc = _c(p)
    lo, hi = _c(base) * low_factor, _c(base) * high_factor
    return F.when(pc < lo, "Approve").when((pc > hi) & ~F.isnan(pc.cast("double")), "Block").otherwise("Review").alias("decision")


def policy_alpha_blend(p="p_xgb", err="ae_err", review=None, block=None, alpha=0.7,
                       t_low=0.25, t_high=0.75, gray_only=False, xgb_low=0.05,
                       xgb_high=0.80) -> list[Column]:
    """Documented-only blend ``alpha*p + (1-alpha)*p_ae`` with p_ae in {0, .5, 1}."""
    e = _c(err)
    p_ae = F.when(e.isNull(), 0.0).when(at_least(e, block), 1.0).when(at_least(e, review), 0.5).otherwise(0.0)
    if gray_only:
        p_ae = F.when(in_gray_zone(p, xgb_low, xgb_high), p_ae).otherwise(F.lit(0.0))
    final = F.lit(alpha) * _c(p) + F.lit(1 - alpha) * p_ae
    decision = (F.when(final <= _c(t_low), "APPROVE").when(at_least(final, t_high), "BLOCK")
                .otherwise("REVIEW"))
    return [p_ae.alias("p_ae"), final.alias("p_final"), decision.alias("decision")]


def policy_rules_fallback(codes="rule_codes") -> list[Column]:
    s = rule_score(_c(codes))
    decision = (F.when(s >= RULE_BLOCK_SCORE, "BLOCK").when(s >= RULE_REVIEW_SCORE, "REVIEW")
                .otherwise("APPROVE"))
    return [s.alias("rule_score"), decision.alias("decision")]


def model_feature_complete(features="features") -> Column:
    """True if ANY of V1..V28 is present (parity with the reference)."""
    keys = F.map_keys(_c(features))
    return F.exists(keys, lambda k: k.rlike(r"^V([1-9]|1[0-9]|2[0-8])$"))


def policy_checkout_router(df: DataFrame, features="features", p="p_xgb", err="ae_err",
                           t_low=0.05, t_high=0.80, ae_block=None, **rule_cols) -> DataFrame:
    """ML path when model features are present (and p exists), else rules.

    Adds ``decision``, ``reason_codes``, ``path``."""
    ml = model_feature_complete(features) & _c(p).isNotNull()
    codes = rule_reason_codes(**rule_cols)
    s = rule_score(codes)
    pc, e = _c(p), _c(err)
    aeb = e.isNotNull() & (at_least(e, ae_block))
    decision = (F.when(ml & (pc < _c(t_low)), "APPROVE").when(ml & (at_least(pc, t_high)), "BLOCK")
                .when(ml & aeb, "BLOCK").when(ml, "REVIEW")
                .when(s >= RULE_BLOCK_SCORE, "BLOCK").when(s >= RULE_REVIEW_SCORE, "REVIEW")
                .otherwise("APPROVE"))
    path = (F.when(ml & (pc < _c(t_low)), "ml_xgb_low").when(ml & (at_least(pc, t_high)), "ml_xgb_high")
            .when(ml & aeb, "ml_ae_block").when(ml, "ml_grey_zone")
            .when(s >= RULE_BLOCK_SCORE, "rules_block").when(s >= RULE_REVIEW_SCORE, "rules_review")
            .otherwise("rules_approve"))
    reasons = (F.when(ml & (pc < _c(t_low)), F.array().cast("array<string>"))
               .when(ml & (at_least(pc, t_high)), F.array(F.lit("xgb_high_risk")))
               .when(ml & aeb, F.array(F.lit("ae_high_recon_error")))
               .when(ml, F.array(F.lit("xgb_grey_zone"))).otherwise(codes))
    return df.select("*", decision.alias("decision"), reasons.alias("reason_codes"), path.alias("path"))


def policy_ae_triage(err="ae_err", review=None, block=None) -> Column:
    e = _c(err)
    return F.when(at_least(e, block), 2).when(at_least(e, review), 1).otherwise(0).alias("ae_triage")


def score_hybrid_proxy(p="p_xgb", err="ae_err", t_low=0.05, t_high=0.80, lo=None, hi=None) -> Column:
    """0 below the band, 1 above, min-max scaled error inside."""
    pc = _c(p)
    scaled = F.when(_c(hi) > _c(lo), (_c(err) - _c(lo)) / (_c(hi) - _c(lo))).otherwise(F.lit(0.0))
    return F.when(pc < _c(t_low), 0.0).when(at_least(pc, t_high), 1.0).otherwise(scaled).alias("hybrid_score")
