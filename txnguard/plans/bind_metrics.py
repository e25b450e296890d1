"""Queries for evaluation, statistics and calibration sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.operators import aggregates as A
from txnguard.operators import calibrate, metrics, policy
from txnguard.oracles import SCORED, THR, TXN, with_
from txnguard.sources.tables import XGB_T_HIGH, XGB_T_LOW, txn

PRED_SQL = """preds AS (
  SELECT *, CASE WHEN p_xgb >= 0.5 THEN 1 ELSE 0 END AS pred_xgb,
         CASE WHEN p_xgb < 0.05 THEN 0 WHEN p_xgb >= 0.8 THEN 1 WHEN ae_err >= ae_review THEN 1 ELSE 0 END AS pred_hybrid,
         CASE WHEN p_xgb < 0.05 THEN 0 WHEN p_xgb >= 0.8 THEN 1 WHEN p_xgb >= 0.5 THEN 1 ELSE 0 END AS pred_thr,
         CASE WHEN ae_err >= ae_review THEN 1 ELSE 0 END AS pred_ae
  FROM scored)"""
P = with_(TXN, THR, SCORED, PRED_SQL)


def preds(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    return s.select(
        "*", (F.col("p_xgb") >= 0.5).cast("int").alias("pred_xgb"),
        policy.policy_hybrid_binary("p_xgb", "ae_err", XGB_T_LOW, XGB_T_HIGH, F.col("ae_review")).alias("pred_hybrid"),
        policy.policy_threshold_only("p_xgb", XGB_T_LOW, XGB_T_HIGH, 0.5).alias("pred_thr"),
        (F.col("ae_err") >= F.col("ae_review")).cast("int").alias("pred_ae"))


CONF_SQL = """SELECT count(*) FILTER (WHERE label = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE label = 0 AND {p} = 1) AS fp,
       count(*) FILTER (WHERE label = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE label = 1 AND {p} = 1) AS tp FROM preds"""
PRF_SQL = """round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
       round(CASE WHEN tp + fp > 0 AND tp + fn > 0 AND tp > 0
             THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / ((tp / (tp + fp)) + (tp / (tp + fn))) ELSE 0 END, 6) AS f1"""


@query("eval_confusion", P + CONF_SQL.format(p="pred_hybrid"))
def q_confusion(spark, sf_dir):
    return metrics.confusion(preds(spark, sf_dir), "label", "pred_hybrid")


@query("eval_prf", P + ", c AS (" + CONF_SQL.format(p="pred_hybrid") + ") SELECT *, " + PRF_SQL + " FROM c")
def q_prf(spark, sf_dir):
    return metrics.prf(metrics.confusion(preds(spark, sf_dir), "label", "pred_hybrid"))


@query("eval_fpr_fnr", P + ", c AS (" + CONF_SQL.format(p="pred_xgb") + """)
SELECT *, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 6) AS fpr,
       round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 6) AS fnr FROM c""")
def q_fpr_fnr(spark, sf_dir):
    return metrics.fpr_fnr(metrics.confusion(preds(spark, sf_dir), "label", "pred_xgb"))


@query("eval_classification_report", P + ", c AS (" + CONF_SQL.format(p="pred_xgb") + """),
per AS (SELECT '1' AS class, tp + fn AS support, tp, fp, fn FROM c
        UNION ALL SELECT '0', tn + fp, tn, fn, fp FROM c),
m AS (SELECT class, support, """ + PRF_SQL + """ FROM per)
SELECT * FROM m
UNION ALL SELECT 'accuracy', tp + tn + fp + fn, round((tp + tn) / (tp + tn + fp + fn), 6),
       round((tp + tn) / (tp + tn + fp + fn), 6), round((tp + tn) / (tp + tn + fp + fn), 6) FROM c
UNION ALL SELECT 'macro avg', sum(support), round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6) FROM m
UNION ALL SELECT 'weighted avg', sum(support), round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6) FROM m""")
def q_class_report(spark, sf_dir):
    return metrics.classification_report(preds(spark, sf_dir), "label", "pred_xgb")


@query("eval_two_views", P + """, v AS (SELECT label, CASE WHEN decision IN ('REVIEW', 'BLOCK') THEN 1 ELSE 0 END AS flagged,
                       CASE WHEN decision = 'BLOCK' THEN 1 ELSE 0 END AS block_only FROM preds),
c AS (SELECT 'flagged' AS view, count(*) FILTER (WHERE label = 0 AND flagged = 0) AS tn,
             count(*) FILTER (WHERE label = 0 AND flagged = 1) AS fp, count(*) FILTER (WHERE label = 1 AND flagged = 0) AS fn,
             count(*) FILTER (WHERE label = 1 AND flagged = 1) AS tp FROM v
      UNION ALL
      SELECT 'block_only', count(*) FILTER (WHERE label = 0 AND block_only = 0), count(*) FILTER (WHERE label = 0 AND block_only = 1),
             count(*) FILTER (WHERE label = 1 AND block_only = 0), count(*) FILTER (WHERE label = 1 AND block_only = 1) FROM v)
SELECT *, """ + PRF_SQL + " FROM c")
def q_two_views(spark, sf_dir):
    return metrics.two_views(scored_txn(spark, sf_dir), "label")


def _auc_sql(score: str) -> str:
    return with_(TXN) + f""", sc AS (SELECT {score} AS s, count(*) FILTER (WHERE label = 1) AS pos,
                    count(*) FILTER (WHERE label = 0) AS neg FROM txn WHERE {score} IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(neg) OVER (ORDER BY s) AS cum_neg FROM sc)
SELECT round(CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (cum_neg - neg * 0.5)) / (sum(pos) * sum(neg)) END, 6)
       AS roc_auc FROM c"""


@query("eval_roc_auc", _auc_sql("ae_err"))
def q_auc(spark, sf_dir):
    return metrics.roc_auc(txn(spark, sf_dir), "ae_err", "label")


DESC_SQL = """, sc AS (SELECT {s} AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg
             FROM txn WHERE {s} IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS cum_pos, sum(neg) OVER (ORDER BY s DESC) AS cum_neg,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM sc)"""


@query("eval_average_precision", with_(TXN) + DESC_SQL.format(s="ae_err") + """
SELECT round(CASE WHEN max(P) > 0 THEN sum(pos * cum_pos / (cum_pos + cum_neg)) / max(P) END, 6) AS average_precision FROM c""")
def q_ap(spark, sf_dir):
    return metrics.average_precision(txn(spark, sf_dir), "ae_err", "label")


@query("eval_roc_curve", with_(TXN) + DESC_SQL.format(s="p_xgb") + """
SELECT s AS threshold, round(cum_neg / N, 6) AS fpr, round(cum_pos / P, 6) AS tpr FROM c""")
def q_roc_curve(spark, sf_dir):
    return metrics.roc_curve(txn(spark, sf_dir), "p_xgb", "label")


@query("eval_pr_curve", with_(TXN) + DESC_SQL.format(s="p_xgb") + """
SELECT s AS threshold, round(cum_pos / P, 6) AS recall, round(cum_pos / (cum_pos + cum_neg), 6) AS precision FROM c""")
def q_pr_curve(spark, sf_dir):
    return metrics.pr_curve(txn(spark, sf_dir), "p_xgb", "label")


@query("eval_single_class_guard", with_(TXN) + """, one AS (SELECT * FROM txn WHERE event_type = 'error'),
sc AS (SELECT p_xgb AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM one GROUP BY 1),
c AS (SELECT *, sum(neg) OVER (ORDER BY s) AS cum_neg FROM sc)
SELECT CASE WHEN (SELECT count(DISTINCT label) FROM one) > 1 THEN
       round(sum(pos * (cum_neg - neg * 0.5)) / (sum(pos) * sum(neg)), 6) END AS roc_auc FROM c""")
def q_single_class(spark, sf_dir):
    one = txn(spark, sf_dir).where(F.col("event_type") == "error")  # only class 1
    return metrics.single_class_guard(one, "label", metrics.roc_auc(one, "p_xgb", "label"))


@query("eval_model_comparison", P + """, m AS (
  SELECT 'xgb' AS model, """ + PRF_SQL + " FROM (" + CONF_SQL.format(p="pred_xgb") + """)
  UNION ALL SELECT 'ae', """ + PRF_SQL + " FROM (" + CONF_SQL.format(p="pred_ae") + """)),
sx AS (SELECT p_xgb AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM txn GROUP BY 1),
sa AS (SELECT ae_err AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label = 0) AS neg FROM txn GROUP BY 1),
ax AS (SELECT 'xgb' AS model, round(sum(pos * (cn - neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
              round(sum(pos * cp / (cp + cq)) / sum(pos), 6) AS average_precision
       FROM (SELECT *, sum(neg) OVER (ORDER BY s) AS cn, sum(pos) OVER (ORDER BY s DESC) AS cp,
                    sum(neg) OVER (ORDER BY s DESC) AS cq FROM sx)),
aa AS (SELECT 'ae' AS model, round(sum(pos * (cn - neg * 0.5)) / (sum(pos) * sum(neg)), 6) AS roc_auc,
              round(sum(pos * cp / (cp + cq)) / sum(pos), 6) AS average_precision
       FROM (SELECT *, sum(neg) OVER (ORDER BY s) AS cn, sum(pos) OVER (ORDER BY s DESC) AS cp,
                    sum(neg) OVER (ORDER BY s DESC) AS cq FROM sa)),
w AS (SELECT * FROM m JOIN (SELECT * FROM ax UNION ALL SELECT * FROM aa) USING (model))
SELECT model, 'precision' AS metric, precision AS value FROM w UNION ALL SELECT model, 'recall', recall FROM w
UNION ALL SELECT model, 'f1', f1 FROM w UNION ALL SELECT model, 'roc_auc', roc_auc FROM w
UNION ALL SELECT model, 'average_precision', average_precision FROM w""")
def q_model_comparison(spark, sf_dir):
    p = preds(spark, sf_dir)
    return metrics.model_comparison(p, "label", {"xgb": ("p_xgb", "pred_xgb"), "ae": ("ae_err", "pred_ae")})


@query("eval_ablation", P + ", c AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS config, * FROM (" + CONF_SQL.format(p=c) + ")"
    for n, c in (("xgb", "pred_xgb"), ("threshold_only", "pred_thr"), ("hybrid", "pred_hybrid"))) + ") SELECT *, "
       + PRF_SQL + " FROM c")
def q_ablation(spark, sf_dir):
    return metrics.ablation(preds(spark, sf_dir), "label",
                            {"xgb": "pred_xgb", "threshold_only": "pred_thr", "hybrid": "pred_hybrid"})


@query("eval_mcnemar", P + """, m AS (
  SELECT count(*) FILTER (WHERE pred_xgb = label AND pred_hybrid = label) AS n11,
         count(*) FILTER (WHERE pred_xgb <> label AND pred_hybrid <> label) AS n00,
         count(*) FILTER (WHERE pred_xgb = label AND pred_hybrid <> label) AS n01,
         count(*) FILTER (WHERE pred_xgb <> label AND pred_hybrid = label) AS n10 FROM preds),
b AS (SELECT *, n01 + n10 AS n, least(n01, n10) AS k FROM m),
p AS (SELECT CASE WHEN max(n) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
             + n * ln(0.5)))) END AS p_value FROM b, range(0, b.k + 1) t(i))
SELECT n11, n00, n01, n10, round(p_value, 6) AS p_value,
       CASE WHEN round(p_value, 6) < 0.05 THEN 'significant' ELSE 'not significant' END AS verdict FROM m, p""")
def q_mcnemar(spark, sf_dir):
    return metrics.mcnemar(preds(spark, sf_dir), "label", "pred_xgb", "pred_hybrid")


@query("eval_mcnemar_direction", P + """, m AS (
  SELECT count(*) FILTER (WHERE pred_xgb = label AND pred_hybrid <> label) AS n01,
         count(*) FILTER (WHERE pred_xgb <> label AND pred_hybrid = label) AS n10 FROM preds),
b AS (SELECT *, n01 + n10 AS n, least(n01, n10) AS k FROM m),
e AS (SELECT CASE WHEN max(n) = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
             + n * ln(0.5)))) END AS p FROM b, range(0, CASE WHEN b.n <= 25 THEN b.k + 1 ELSE 1 END) t(i)),
s AS (SELECT n01, n10, CASE WHEN n <= 25 THEN 'exact' ELSE 'chi2' END AS test,
        round(CASE WHEN n <= 25 THEN k ELSE (abs(n01 - n10) - 1) * (abs(n01 - n10) - 1) / n END, 6) AS statistic, p FROM b, e)
SELECT n01, n10, test, CAST(statistic AS DOUBLE) AS statistic,
       CASE WHEN (test = 'exact' AND p >= 0.05) OR (test = 'chi2' AND statistic <= 3.841458820694124) THEN 'none'
            WHEN n01 > n10 THEN 'a' WHEN n10 > n01 THEN 'b' ELSE 'neither' END AS direction FROM s""")
def q_mcnemar_direction(spark, sf_dir):
    """The test by the number of discordant pairs, and which model is better."""
    return metrics.mcnemar_direction(preds(spark, sf_dir), "label", "pred_xgb", "pred_hybrid").drop("p_value")


@query("eval_bootstrap_ci")
def q_bootstrap(spark, sf_dir):
    """Resampling statistic: checked against a NumPy computation in tests."""
    return metrics.bootstrap_ci(preds(spark, sf_dir), "label", "pred_xgb", "pred_hybrid", n_boot=5000, seed=42)


SC_SQL = with_(TXN, THR, SCORED)


@query("eval_flag_reconstruct", SC_SQL + """
SELECT txn_id, coalesce(CASE WHEN p_xgb >= 0.5 THEN 1 ELSE 0 END,
                        CASE WHEN decision IS NOT NULL THEN CASE WHEN upper(decision) IN ('BLOCK', 'REVIEW') THEN 1 ELSE 0 END END)
       AS flag_prob,
       CASE WHEN upper(decision) IN ('BLOCK', 'REVIEW') THEN 1 ELSE 0 END AS flag_decision FROM scored""")
def q_flag_reconstruct(spark, sf_dir):
    s = scored_txn(spark, sf_dir)
    a = metrics.flag_reconstruct(s, ["p_xgb", "missing_prob"], ["decision"], 0.5, "flag_prob")
    b = metrics.flag_reconstruct(a, ["missing_prob"], ["decision"], 0.5, "flag_decision")
    return b.select("txn_id", "flag_prob", "flag_decision")


@query("eval_error_over_time", with_(TXN) + """
SELECT CAST(floor((epoch_s - (SELECT min(epoch_s) FROM txn)) / 3600) AS BIGINT) AS hours_since_start, label,
       count(*) AS n, round(avg(ae_err), 6) AS mean_err, round(max(ae_err), 6) AS max_err FROM txn GROUP BY ALL""")
def q_error_over_time(spark, sf_dir):
    return metrics.error_over_time(txn(spark, sf_dir), "ts", "ae_err", "label")


@query("eval_decision_totals_by_label", SC_SQL + """
SELECT decision, count(*) FILTER (WHERE label = 0) AS legit, count(*) FILTER (WHERE label = 1) AS fraud
FROM scored GROUP BY decision""")
def q_totals(spark, sf_dir):
    return metrics.decision_totals_by_label(scored_txn(spark, sf_dir), "decision", "label")


# ---------------------------------------------------------------- calibration
@query("cal_fpr_thresholds", with_(TXN) + """
SELECT round(quantile_cont(ae_err, 0.99), 6) AS review,
       round(greatest(quantile_cont(ae_err, 0.999), quantile_cont(ae_err, 0.99)), 6) AS block FROM txn WHERE label = 0""")
def q_fpr_thr(spark, sf_dir):
    t = calibrate.fpr_thresholds(txn(spark, sf_dir))
    return t.select(A.r6(F.col("review")).alias("review"), A.r6(F.col("block")).alias("block"))


def _sweep_sql(grid_sql: str, beta: float) -> str:
    b2 = beta * beta
    return with_(TXN) + f""", grid AS ({grid_sql}),
tot AS (SELECT count(*) FILTER (WHERE label = 1) AS P FROM txn),
c AS (SELECT g.grid_pos, g.t, count(txn.txn_id) FILTER (WHERE txn.label = 1) AS tp,
             count(txn.txn_id) FILTER (WHERE txn.label = 0) AS fp
      FROM grid g LEFT JOIN txn ON txn.p_xgb >= g.t GROUP BY g.grid_pos, g.t),
m AS (SELECT c.*, P - tp AS fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision,
             CASE WHEN P > 0 THEN tp / P ELSE 0 END AS recall FROM c, tot)
SELECT grid_pos, round(t, 6) AS t, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(CASE WHEN precision + recall > 0 THEN (1 + {b2}) * precision * recall / ({b2} * precision + recall) ELSE 0 END, 6)
       AS fscore,
       row_number() OVER (ORDER BY CASE WHEN precision + recall > 0 THEN (1 + {b2}) * precision * recall
                          / ({b2} * precision + recall) ELSE 0 END DESC, t) = 1 AS is_best
FROM m"""


def _sweep(spark, sf_dir, grid, beta):
    s = calibrate.threshold_sweep(txn(spark, sf_dir), "p_xgb", "label", grid, beta)
    best = F.row_number().over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy(
        F.col("fscore").desc(), F.col("t").asc())) == 1
    return s.select("grid_pos", A.r6(F.col("t")).alias("t"), "tp", "fp", "fn", A.r6(F.col("precision")).alias("precision"),
                    A.r6(F.col("recall")).alias("recall"), A.r6(F.col("fscore")).alias("fscore"), best.alias("is_best"))


FBETA_GRID = calibrate.sweep_grid(0.001, 0.5, 500)
F1_GRID = calibrate.sweep_grid(0.01, 0.99, 50)


def _grid_values(grid):
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({t!r} AS DOUBLE))" for i, t in enumerate(grid)) + \
        ") v(grid_pos, t)"


@query("cal_threshold_sweep_fbeta", _sweep_sql(_grid_values(FBETA_GRID), 2.0))
def q_sweep_f2(spark, sf_dir):
    return _sweep(spark, sf_dir, FBETA_GRID, 2.0)


@query("cal_threshold_sweep_f1", _sweep_sql(_grid_values(F1_GRID), 1.0))
def q_sweep_f1(spark, sf_dir):
    return _sweep(spark, sf_dir, F1_GRID, 1.0)
