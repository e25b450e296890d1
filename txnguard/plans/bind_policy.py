"""Queries for decision policies, scores and explanations."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.functions import scalar
from txnguard.operators import aggregates as A
from txnguard.operators import explain, policy
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.plans.bindings import CHECKOUT_SQL, FEAT_SQL, checkout, features_txn
from txnguard.plans.scale import percentile_rank
from txnguard.sources.tables import XGB_T_HIGH, XGB_T_LOW, txn

SC = with_(TXN, THR, SCORED)
CHK = with_(TXN, FEAT_SQL, CHECKOUT_SQL)


@query("policy_ae_first", SC + """
SELECT txn_id,
  CASE WHEN ae_err >= ae_block THEN 'BLOCK' WHEN p_xgb >= 0.8 THEN 'BLOCK' WHEN p_xgb <= 0.05 THEN 'APPROVE'
       ELSE 'REVIEW' END AS decision,
  CASE WHEN ae_err >= ae_block THEN 'ae_block_gate' WHEN p_xgb >= 0.8 THEN 'xgb_block_high'
       WHEN p_xgb <= 0.05 THEN 'xgb_approve_low' ELSE 'xgb_gray_zone' END AS reason FROM scored""")
def q_ae_first(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    d, r = policy.policy_ae_first("p_xgb", "ae_err", F.col("ae_block"), XGB_T_LOW, XGB_T_HIGH)
    return s.select("txn_id", d, F.element_at(r, 1).alias("reason"))


@query("policy_threshold_only", SC + """
SELECT txn_id, CASE WHEN p_xgb < 0.05 THEN 0 WHEN p_xgb >= 0.8 THEN 1 WHEN p_xgb >= 0.5 THEN 1 ELSE 0 END AS pred
FROM scored""")
def q_thr_only(spark, sf_dir):
    return scored_txn(spark, sf_dir).select("txn_id", policy.policy_threshold_only("p_xgb", XGB_T_LOW, XGB_T_HIGH, 0.5))


@query("policy_hybrid_binary", SC + """
SELECT txn_id, CASE WHEN p_xgb < 0.05 THEN 0 WHEN p_xgb >= 0.8 THEN 1 WHEN ae_err >= ae_review THEN 1 ELSE 0 END AS pred
FROM scored""")
def q_hybrid_binary(spark, sf_dir):
    return scored_txn(spark, sf_dir).select(
        "txn_id", policy.policy_hybrid_binary("p_xgb", "ae_err", XGB_T_LOW, XGB_T_HIGH, F.col("ae_review")))


@query("policy_scaled_band", with_(TXN) + """
SELECT txn_id, CASE WHEN p_xgb < 0.25 THEN 'Approve' WHEN p_xgb > 0.75 THEN 'Block' ELSE 'Review' END AS decision
FROM txn""")
def q_scaled_band(spark, sf_dir):
    return txn(spark, sf_dir).select("txn_id", policy.policy_scaled_band("p_xgb", 0.5))


@query("policy_alpha_blend", SC + """
, b AS (SELECT txn_id, CASE WHEN ae_err IS NULL THEN 0.0 WHEN ae_err >= ae_block THEN 1.0 WHEN ae_err >= ae_review THEN 0.5
                            ELSE 0.0 END AS p_ae, p_xgb FROM scored)
SELECT txn_id, p_ae, round(0.7 * p_xgb + 0.30000000000000004 * p_ae, 6) AS p_final,
       CASE WHEN 0.7 * p_xgb + 0.30000000000000004 * p_ae <= 0.25 THEN 'APPROVE'
            WHEN 0.7 * p_xgb + 0.30000000000000004 * p_ae >= 0.75 THEN 'BLOCK' ELSE 'REVIEW' END AS decision FROM b""")
def q_alpha(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    p_ae, final, dec = policy.policy_alpha_blend("p_xgb", "ae_err", F.col("ae_review"), F.col("ae_block"))
    return s.select("txn_id", p_ae, A.r6(final).alias("p_final"), dec)


RULES_SQL = """rules AS (
  SELECT txn_id,
    list_filter([
      CASE WHEN country IS NOT NULL AND country <> '' AND ip_country IS NOT NULL AND ip_country <> '' AND country <> ip_country THEN 'geo_mismatch' END,
      CASE WHEN currency IS NOT NULL AND currency <> '' AND card_currency IS NOT NULL AND card_currency <> '' AND currency <> card_currency THEN 'currency_mismatch' END,
      CASE WHEN hour IN (0, 1, 2, 3, 4, 5) THEN 'night_txn' END,
      CASE WHEN amount >= 900.0 THEN 'high_amount' END,
      CASE WHEN coalesce(velocity_1h, 0) >= 6 THEN 'high_velocity_1h' END,
      CASE WHEN coalesce(velocity_24h, 0) >= 20 THEN 'high_velocity_24h' END,
      CASE WHEN is_proxy_vpn THEN 'proxy_vpn' END,
      CASE WHEN is_new_device THEN 'new_device' END,
      CASE WHEN ip_country IN ('NATION_3', 'NATION_7', 'NATION_11', 'NATION_19') THEN 'risky_ip_country' END], lambda x: x IS NOT NULL)
    AS codes, p_xgb, ae_err
  FROM chk),
scored_rules AS (
  SELECT *, list_sum(list_transform(codes, lambda c: CASE c WHEN 'geo_mismatch' THEN 2 WHEN 'currency_mismatch' THEN 1
      WHEN 'night_txn' THEN 1 WHEN 'high_amount' THEN 1 WHEN 'high_velocity_1h' THEN 2 WHEN 'high_velocity_24h' THEN 2
      WHEN 'proxy_vpn' THEN 2 WHEN 'new_device' THEN 1 WHEN 'risky_ip_country' THEN 2 ELSE 1 END)) AS score
  FROM rules)"""

# The binding's "risky" nations (the reference list holds ISO codes absent from the test tables).
RISKY_NATIONS = ["NATION_3", "NATION_7", "NATION_11", "NATION_19"]


def _rule_codes():
    return scalar.rule_reason_codes(risky=RISKY_NATIONS)


@query("policy_rules_fallback", with_(TXN, FEAT_SQL, CHECKOUT_SQL, RULES_SQL) + """
SELECT txn_id, array_to_string(codes, ',') AS rule_codes, CAST(coalesce(score, 0) AS BIGINT) AS rule_score,
       CASE WHEN coalesce(score, 0) >= 6 THEN 'BLOCK' WHEN coalesce(score, 0) >= 3 THEN 'REVIEW' ELSE 'APPROVE' END AS decision
FROM scored_rules""")
def q_rules(spark, sf_dir):
    c = checkout(spark, sf_dir).withColumn("codes", _rule_codes())
    s, d = policy.policy_rules_fallback("codes")
    return c.select("txn_id", F.array_join("codes", ",").alias("rule_codes"), s.cast("long").alias("rule_score"), d)


@query("fn_rule_flags", with_(TXN, FEAT_SQL, CHECKOUT_SQL, RULES_SQL) + """
SELECT txn_id, array_to_string(codes, ',') AS rule_codes FROM rules""")
def q_rule_flags(spark, sf_dir):
    c = checkout(spark, sf_dir)
    return c.select("txn_id", F.array_join(_rule_codes(), ",").alias("rule_codes"))


@query("policy_checkout_router", with_(TXN, THR, FEAT_SQL, CHECKOUT_SQL, RULES_SQL) + """
, r AS (SELECT s.*, c.event_type <> 'view' AS ml, thr.ae_block FROM scored_rules s JOIN txn c USING (txn_id), thr)
SELECT txn_id,
  CASE WHEN ml AND p_xgb < 0.05 THEN 'APPROVE' WHEN ml AND p_xgb >= 0.8 THEN 'BLOCK'
       WHEN ml AND ae_err >= ae_block THEN 'BLOCK' WHEN ml THEN 'REVIEW'
       WHEN coalesce(score, 0) >= 6 THEN 'BLOCK' WHEN coalesce(score, 0) >= 3 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
  CASE WHEN ml AND p_xgb < 0.05 THEN 'ml_xgb_low' WHEN ml AND p_xgb >= 0.8 THEN 'ml_xgb_high'
       WHEN ml AND ae_err >= ae_block THEN 'ml_ae_block' WHEN ml THEN 'ml_grey_zone'
       WHEN coalesce(score, 0) >= 6 THEN 'rules_block' WHEN coalesce(score, 0) >= 3 THEN 'rules_review'
       ELSE 'rules_approve' END AS path,
  CASE WHEN ml AND p_xgb < 0.05 THEN '' WHEN ml AND p_xgb >= 0.8 THEN 'xgb_high_risk'
       WHEN ml AND ae_err >= ae_block THEN 'ae_high_recon_error' WHEN ml THEN 'xgb_grey_zone'
       ELSE array_to_string(codes, ',') END AS reason_codes
FROM r""")
def q_router(spark, sf_dir):
    t = txn(spark, sf_dir)
    from txnguard.operators import calibrate
    thr = calibrate.percentile_thresholds(t).select(F.col("block").alias("ae_block"))
    c = checkout(spark, sf_dir).join(t.select("txn_id", "event_type"), "txn_id")
    feats = F.when(F.col("event_type") != "view", F.create_map(F.lit("V1"), F.col("amount"))) \
        .otherwise(F.create_map(F.lit("amount"), F.col("amount")))
    c = c.withColumn("features", feats).crossJoin(F.broadcast(thr))
    out = policy.policy_checkout_router(c, "features", "p_xgb", "ae_err", XGB_T_LOW, XGB_T_HIGH,
                                        F.col("ae_block"), risky=RISKY_NATIONS)
    return out.select("txn_id", "decision", "path", F.array_join("reason_codes", ",").alias("reason_codes"))


@query("policy_ae_triage", SC + """
SELECT txn_id, CASE WHEN ae_err >= ae_block THEN 2 WHEN ae_err >= ae_review THEN 1 ELSE 0 END AS ae_triage FROM scored""")
def q_ae_triage(spark, sf_dir):
    return scored_txn(spark, sf_dir).select("txn_id", policy.policy_ae_triage("ae_err", F.col("ae_review"),
                                                                              F.col("ae_block")))


@query("score_ae_bucket", SC + """
SELECT txn_id, CASE WHEN ae_err >= ae_block THEN 'extreme' WHEN ae_err >= ae_review THEN 'elevated' ELSE 'normal' END
       AS bucket FROM scored""")
def q_ae_bucket(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    return s.select("txn_id", policy.ae_bucket("ae_err", F.col("ae_review"), F.col("ae_block")).alias("bucket"))


@query("score_hybrid_proxy", with_(TXN) + """
, mm AS (SELECT min(ae_err) AS lo, max(ae_err) AS hi FROM txn)
SELECT txn_id, round(CASE WHEN p_xgb < 0.05 THEN 0.0 WHEN p_xgb >= 0.8 THEN 1.0
                          WHEN hi > lo THEN (ae_err - lo) / (hi - lo) ELSE 0.0 END, 6) AS hybrid_score FROM txn, mm""")
def q_hybrid_proxy(spark, sf_dir):
    t = txn(spark, sf_dir)
    mm = t.agg(F.min("ae_err").alias("lo"), F.max("ae_err").alias("hi"))
    s = t.crossJoin(F.broadcast(mm))
    return s.select("txn_id", A.r6(policy.score_hybrid_proxy("p_xgb", "ae_err", XGB_T_LOW, XGB_T_HIGH,
                                                              F.col("lo"), F.col("hi"))).alias("hybrid_score"))


def explained(spark, sf_dir):
    """Scored + business features + percentile of the gated anomaly score
    in the legit baseline + reason details."""
    s = scored_txn(spark, sf_dir)
    f = features_txn(spark, sf_dir, ["is_new_device", "txn_count_60m", "txn_count_30m", "amount_zscore"]).select(
        "txn_id", F.col("country_mismatch").cast("double").alias("f_country_mismatch"),
        F.col("is_new_device").cast("double").alias("f_new_device"),
        F.col("is_proxy_vpn").cast("double").alias("f_proxy"),
        (F.col("geo_distance_km") / 1000.0).alias("f_distance"),
        F.col("txn_count_60m").alias("f_velocity_60m"), F.col("txn_count_30m").alias("f_velocity_30m"),
        F.col("amount_zscore").alias("f_zscore"), ((F.col("k") - 50) / 10.0).alias("f_v7"),
        F.lit(0.0).alias("f_v10"), F.lit(0.0).alias("f_v14"))
    legit = s.where(F.col("label") == 0).select("ae_err")
    s = percentile_rank(s, "ae_err_g", legit, "ae_err", "ae_percentile")
    j = s.join(f, "txn_id")
    return j.withColumn("reason_details", explain.reason_details())


EXPLAIN_SQL = """ex AS (
  SELECT s.*, CASE WHEN s.ae_err_g IS NULL THEN NULL ELSE 100.0 * (SELECT count(*) FROM txn l WHERE l.label = 0
           AND l.ae_err <= s.ae_err_g) / (SELECT count(*) FROM txn l WHERE l.label = 0) END AS ae_percentile,
         CAST(f.country_mismatch AS DOUBLE) AS f_country_mismatch, CAST(f.is_new_device AS DOUBLE) AS f_new_device,
         CAST(f.is_proxy_vpn AS DOUBLE) AS f_proxy, f.geo_distance_km / 1000.0 AS f_distance,
         f.txn_count_60m AS f_velocity_60m, f.txn_count_30m AS f_velocity_30m, f.amount_zscore AS f_zscore,
         (f.k - 50) / 10.0 AS f_v7
  FROM scored s JOIN feat f USING (txn_id)),
sig AS (
  SELECT *, list_filter([
      CASE WHEN coalesce(f_country_mismatch, 0) = 1 THEN 'c' END, CASE WHEN coalesce(f_new_device, 0) = 1 THEN 'd' END,
      CASE WHEN coalesce(f_proxy, 0) = 1 THEN 'p' END,
      CASE WHEN f_distance IS NOT NULL AND f_distance > 1.0 THEN 'g' END,
      CASE WHEN coalesce(f_velocity_60m, 0) > 1.0 OR coalesce(f_velocity_30m, 0) > 1.0 THEN 'v' END,
      CASE WHEN f_zscore IS NOT NULL AND abs(f_zscore) > 1.5 THEN 'z' END,
      CASE WHEN greatest(abs(coalesce(f_v7, 0)), 0.0, 0.0) > 2.5 THEN 'e' END], lambda x: x IS NOT NULL) AS xs,
    list_filter([CASE WHEN ae_percentile IS NOT NULL AND ae_percentile > 90 THEN 'a' END,
                 CASE WHEN ae_bucket = 'extreme' THEN 'x' END], lambda x: x IS NOT NULL) AS aes
  FROM ex)"""


@query("explain_reason_details", with_(TXN, THR, SCORED, FEAT_SQL, EXPLAIN_SQL) + """
SELECT txn_id, array_to_string(list_filter([
    CASE WHEN decision = 'BLOCK' THEN 'HIGH_RISK_SCORE' WHEN decision = 'REVIEW' THEN 'UNCERTAIN_RISK_SCORE' END,
    CASE WHEN len(xs) > 0 THEN 'XGB_CONTRIBUTING_SIGNALS' END, CASE WHEN len(aes) > 0 THEN 'AE_CONTRIBUTING_SIGNALS' END,
    CASE WHEN decision = 'REVIEW' THEN 'HUMAN_REVIEW_RECOMMENDED' END], lambda x: x IS NOT NULL), ',') AS reason_codes,
  CAST(len(xs) + len(aes) AS BIGINT) AS n_signals, round(ae_percentile, 6) AS ae_percentile
FROM sig""")
def q_reasons(spark, sf_dir):
    e = explained(spark, sf_dir)
    r = F.col("reason_details")
    return e.select("txn_id", F.array_join(F.transform(r, lambda x: x["code"]), ",").alias("reason_codes"),
                    F.aggregate(r, F.lit(0).cast("long"),
                                lambda acc, x: acc + F.coalesce(F.size(x["signals"]), F.lit(0)).cast("long"))
                    .alias("n_signals"),
                    A.r6(F.col("ae_percentile")).alias("ae_percentile"))


PAYLOAD_TEXT_SQL = """'cat__event_type_' || event_type || '=1.000000|num__amount=' || CAST(CAST(amount AS DECIMAL(18, 6)) AS VARCHAR)
    || '|num__p=' || CAST(CAST(p_xgb AS DECIMAL(18, 6)) AS VARCHAR)"""


def payload_map():
    exact = "decimal(18,6)"  # printed alike by every engine
    return F.create_map(F.lit("num__p"), F.col("p_xgb").cast(exact), F.lit("num__amount"), F.col("amount").cast(exact),
                        F.concat(F.lit("cat__event_type_"), F.col("event_type")), F.lit(1.0).cast(exact))


@query("resp_decision_record", with_(TXN, THR, SCORED, FEAT_SQL, EXPLAIN_SQL) + f"""
SELECT decision, sha256({PAYLOAD_TEXT_SQL}) AS payload_hash, 'rev_' || substr(sha256({PAYLOAD_TEXT_SQL}), 1, 16) AS review_id,
       p_xgb AS xgb_probability, ae_err_g AS ae_error, ae_bucket, round(ae_percentile, 6) AS ae_percentile_vs_legit,
       CASE WHEN decision <> 'APPROVE' THEN CAST(
         (CASE WHEN decision IN ('BLOCK', 'REVIEW') THEN 1 ELSE 0 END) + (CASE WHEN len(xs) > 0 THEN 1 ELSE 0 END)
         + (CASE WHEN len(aes) > 0 THEN 1 ELSE 0 END) + (CASE WHEN decision = 'REVIEW' THEN 1 ELSE 0 END) AS INTEGER) END
         AS n_reasons
FROM sig""")
def q_response(spark, sf_dir):
    e = explained(spark, sf_dir)
    e = e.withColumn("payload_hash", scalar.payload_hash(payload_map()))
    e = e.withColumn("review_id", scalar.review_id("payload_hash"))
    rec = explain.decision_record(err="ae_err_g").alias("r")
    return e.select(rec).select(
        "r.decision", "r.request.payload_hash", "r.request.review_id", "r.scores.xgb_probability",
        "r.scores.ae_error", "r.scores.ae_bucket", A.r6(F.col("r.scores.ae_percentile_vs_legit"))
        .alias("ae_percentile_vs_legit"), F.size("r.reason_details").alias("n_reasons")).withColumn(
        "n_reasons", F.when(F.col("decision") != "APPROVE", F.col("n_reasons")))


# Fixed what-if templates of the scenario expansion (template, score boost).
SCENARIOS = [("proxy_on", 0.10), ("new_device", 0.05), ("night_time", 0.02)]


@query("explain_scenario_expansion", SC + """
, tpl AS (SELECT * FROM (VALUES ('proxy_on', 0.10), ('new_device', 0.05), ('night_time', 0.02)) v(template, boost)),
x AS (SELECT s.txn_id, tpl.template, least(1.0, s.p_xgb + tpl.boost) AS p_new FROM scored s, tpl
      WHERE s.decision = 'REVIEW'),
k AS (SELECT * FROM x WHERE p_new >= 0.05 AND p_new < 0.8)
SELECT txn_id, template, round(p_new, 6) AS p_new FROM (
  SELECT *, row_number() OVER (PARTITION BY template ORDER BY txn_id) AS rn FROM k) WHERE rn <= 50""")
def q_scenarios(spark, sf_dir):
    s = scored_txn(spark, sf_dir).where(F.col("decision") == "REVIEW").select("txn_id", "p_xgb")
    tpl = spark.createDataFrame(SCENARIOS, "template string, boost double")

    def rescore(df):
        return df.withColumn("p_new", F.least(F.lit(1.0), F.col("p_xgb") + F.col("boost")))
    out = explain.scenario_expansion(s, tpl, rescore, policy.in_gray_zone("p_new", XGB_T_LOW, XGB_T_HIGH),
                                     "txn_id", 50)
    return out.select("txn_id", "template", A.r6(F.col("p_new")).alias("p_new"))
