"""DuckDB oracle SQL for every registered query (same column names).

The driver registers only the base tables as views, so the bindings of
``txnguard.sources.tables`` are repeated here as CTEs.
"""

from __future__ import annotations

TXN = """txn AS (
  SELECT event_id AS txn_id, user_id AS device_id, ts,
         CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) // 1000 AS epoch_s,
         (CAST(round(epoch_us(ts) / 1000.0) AS BIGINT) // 1000) // 144 AS t,
         value AS amount,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         event_type,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / 100.0 AS p_xgb,
         value AS ae_err
  FROM events)"""

THR = """thr AS (
  SELECT quantile_cont(ae_err, 0.95) AS ae_review, quantile_cont(ae_err, 0.995) AS ae_block,
         count(ae_err) AS n_legit
  FROM txn WHERE label = 0)"""

SCORED = """scored0 AS (
  SELECT txn.*, thr.ae_review, thr.ae_block,
         CASE WHEN p_xgb >= 0.05 AND p_xgb < 0.8 THEN ae_err END AS ae_err_g
  FROM txn CROSS JOIN thr),
scored1 AS (
  SELECT *, CASE WHEN ae_err_g IS NULL THEN 'n/a' WHEN ae_err_g >= ae_block THEN 'extreme'
                 WHEN ae_err_g >= ae_review THEN 'elevated' ELSE 'normal' END AS ae_bucket
  FROM scored0),
scored AS (
  SELECT *,
    CASE WHEN p_xgb < 0.05 THEN 'APPROVE' WHEN p_xgb >= 0.8 THEN 'BLOCK'
         WHEN ae_bucket = 'extreme' THEN 'BLOCK' ELSE 'REVIEW' END AS decision,
    CASE WHEN p_xgb < 0.05 THEN ''
         WHEN p_xgb >= 0.8 THEN 'xgb_high_risk'
         WHEN ae_bucket = 'extreme' THEN 'xgb_gray_zone,ae_block_gate'
         WHEN ae_bucket = 'elevated' THEN 'xgb_gray_zone,ae_review_gate'
         ELSE 'xgb_gray_zone' END AS reason_codes
  FROM scored1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_(TXN)
SCORED_BASE = with_(TXN, THR, SCORED)

VEL = """velw AS (
  SELECT txn_id,
    row_number() OVER (PARTITION BY device_id ORDER BY t, txn_id) AS rn,
    count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 301 PRECEDING) AS o5,
    count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1801 PRECEDING) AS o30,
    count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 3601 PRECEDING) AS o60
  FROM txn)"""

ORACLES: dict[str, str] = {}

ORACLES["flagship_enriched_triage"] = with_(TXN, THR, SCORED, VEL, """z AS (
  SELECT txn_id, round_even((amount - avg(amount) OVER (PARTITION BY device_id))
         / (stddev_pop(amount) OVER (PARTITION BY device_id) + 1e-9), 3) + 0.0 AS amount_zscore FROM txn)""") + """
SELECT decision, count(*) AS n, CAST(sum(label) AS BIGINT) AS n_fraud,
       round(avg(rn - o60), 6) AS avg_txn_count_60m, round(avg(amount_zscore), 6) AS avg_amount_zscore,
       round(count(*) / sum(count(*)) OVER (), 6) AS rate
FROM scored JOIN velw USING (txn_id) JOIN z USING (txn_id)
GROUP BY decision"""

ORACLES["win_velocity_inclusive"] = with_(TXN, VEL) + """
SELECT txn_id, rn - o5 AS txn_count_5m, rn - o30 AS txn_count_30m, rn - o60 AS txn_count_60m FROM velw"""

ORACLES["win_velocity_prior"] = BASE + """
SELECT txn_id,
  count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN 300 PRECEDING AND 1 PRECEDING) AS txn_count_5m_prior,
  count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN 1800 PRECEDING AND 1 PRECEDING) AS txn_count_30m_prior,
  count(*) OVER (PARTITION BY device_id ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS txn_count_60m_prior
FROM txn"""

ORACLES["win_rolling_mean_50"] = BASE + """
SELECT txn_id, round_even(CAST(sum(round(amount * 100)) OVER w AS DOUBLE) / count(amount) OVER w, 0) / 100.0
       AS avg_amount_50
FROM txn WINDOW w AS (PARTITION BY device_id ORDER BY t, txn_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)"""

ORACLES["win_rolling_mean_7d"] = BASE + """
SELECT txn_id, round_even(CAST(sum(round(amount * 100)) OVER w AS DOUBLE) / count(amount) OVER w, 0) / 100.0
       AS avg_amount_7d
FROM txn WINDOW w AS (PARTITION BY device_id ORDER BY epoch_s RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)"""

ORACLES["win_zscore_device"] = BASE + """
SELECT txn_id, round_even((amount - avg(amount) OVER (PARTITION BY device_id))
       / (stddev_pop(amount) OVER (PARTITION BY device_id) + 1e-9), 3) + 0.0 AS amount_zscore FROM txn"""

ORACLES["win_zscore_pit"] = BASE + """
SELECT txn_id, round_even((amount - avg(amount) OVER w) / (stddev_pop(amount) OVER w + 1e-9), 3) + 0.0
       AS amount_zscore_pit
FROM txn WINDOW w AS (PARTITION BY device_id ORDER BY t, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

ORACLES["cal_percentile_thresholds"] = with_(TXN, THR) + """
SELECT round(ae_review, 6) AS review, round(ae_block, 6) AS block, n_legit FROM thr"""

ORACLES["policy_api"] = SCORED_BASE + """
SELECT txn_id, decision, ae_bucket, reason_codes FROM scored"""

ORACLES["agg_triage_rates"] = SCORED_BASE + """
SELECT decision, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS rate
FROM scored GROUP BY decision"""
