"""Queries for drift (PSI) and robustness probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query
from txnguard.operators import aggregates as A
from txnguard.operators import drift, policy, robust
from txnguard.oracles import THR, TXN, with_
from txnguard.sources.tables import XGB_T_HIGH, XGB_T_LOW, read_table, txn

CUTOFF = "2024-01-16"
FEATURES = ["amount", "device_id", "event_type", "hour", "k", "label"]


def _sides(spark, sf_dir):
    t = txn(spark, sf_dir).withColumn("hour", F.hour("ts"))
    cut = F.lit(CUTOFF).cast("timestamp")
    return (t.where(F.col("ts") < cut).select(*FEATURES), t.where(F.col("ts") >= cut).select(*FEATURES))


def _long_sql(features: list[str], baseline: str, current: str) -> str:
    parts = []
    for side, cond in (("baseline", baseline), ("current", current)):
        for f in features:
            expr = "CAST(hour(ts) AS VARCHAR)" if f == "hour" else f"CAST({f} AS VARCHAR)"
            parts.append(f"SELECT '{side}' AS side, '{f}' AS feature, coalesce({expr}, 'nan') AS s, "
                         f"TRY_CAST({expr} AS DOUBLE) AS x FROM txn WHERE {cond}")
    return "lng AS (" + "\nUNION ALL ".join(parts) + ")"


EDGE_PROBS = "[" + ", ".join(f"{i / 10}" for i in range(11)) + "]"

_PSI = f""",
types AS (SELECT feature, avg(CASE WHEN x IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.98 AS is_numeric
          FROM lng WHERE side = 'baseline' GROUP BY feature),
num AS (SELECT l.* FROM lng l JOIN types USING (feature) WHERE is_numeric AND x IS NOT NULL),
cnt AS (SELECT feature, count(*) FILTER (WHERE side = 'baseline') AS n_e, count(*) FILTER (WHERE side = 'current') AS n_a
        FROM num GROUP BY feature),
ok AS (SELECT feature FROM cnt WHERE n_e >= 50 AND n_a >= 50),
clip AS (SELECT feature, quantile_cont(x, 0.001) AS lo, quantile_cont(x, 0.999) AS hi FROM num
         WHERE side = 'baseline' AND feature IN (SELECT feature FROM ok) GROUP BY feature),
cl AS (SELECT n.feature, n.side, least(greatest(n.x, clip.lo), clip.hi) AS xc FROM num n JOIN clip USING (feature)),
edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(xc, {EDGE_PROBS}))) AS edges FROM cl
          WHERE side = 'baseline' GROUP BY feature),
bn AS (SELECT cl.feature, side, least(len(list_filter(edges, lambda e: e <= xc)), len(edges) - 1) AS bin
       FROM cl JOIN edges USING (feature) WHERE len(edges) >= 3),
bc AS (SELECT feature, bin, count(*) FILTER (WHERE side = 'baseline') AS e_cnt,
              count(*) FILTER (WHERE side = 'current') AS a_cnt FROM bn GROUP BY ALL),
allb AS (SELECT feature, unnest(range(1, len(edges))) AS bin FROM edges WHERE len(edges) >= 3),
ncells AS (SELECT a.feature, coalesce(bc.e_cnt, 0) AS e_cnt, coalesce(bc.a_cnt, 0) AS a_cnt
           FROM allb a LEFT JOIN bc USING (feature, bin)),
ccells AS (SELECT l.feature, count(*) FILTER (WHERE side = 'baseline') AS e_cnt, count(*) FILTER (WHERE side = 'current') AS a_cnt
           FROM lng l JOIN types USING (feature) WHERE NOT is_numeric GROUP BY l.feature, l.s),
ck AS (SELECT feature, count(*) AS n_cat FROM ccells GROUP BY feature),
cells AS (SELECT * FROM ncells UNION ALL SELECT c.* FROM ccells c JOIN ck USING (feature) WHERE n_cat > 1),
pc AS (SELECT feature, e_cnt, a_cnt, sum(e_cnt) OVER w AS e_tot, sum(a_cnt) OVER w AS a_tot, count(*) OVER w AS kk
       FROM cells WINDOW w AS (PARTITION BY feature)),
pe AS (SELECT feature, greatest(CASE WHEN e_tot > 0 THEN e_cnt / e_tot ELSE 1.0 / greatest(kk, 1) END, 1e-6) AS e,
              greatest(CASE WHEN a_tot > 0 THEN a_cnt / a_tot ELSE 1.0 / greatest(kk, 1) END, 1e-6) AS a FROM pc),
psi AS (SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM pe GROUP BY feature
        UNION ALL SELECT feature, 0.0 FROM edges WHERE len(edges) < 3
        UNION ALL SELECT feature, 0.0 FROM ck WHERE n_cat <= 1
        UNION ALL SELECT feature, NULL FROM cnt WHERE feature NOT IN (SELECT feature FROM ok)),
rep AS (SELECT feature, psi, is_numeric,
               CASE WHEN psi IS NULL OR isnan(psi) THEN 'unknown' WHEN psi < 0.10 THEN 'stable' WHEN psi < 0.25 THEN 'moderate'
                    ELSE 'significant' END AS status FROM psi JOIN types USING (feature))"""



def psi_sql(features: list[str], baseline: str, current: str) -> str:
    """CTEs from ``txn`` to ``rep`` (feature, psi, is_numeric, status) of the rows that meet either condition."""
    return _long_sql(features, baseline, current) + _PSI


PSI_SQL = psi_sql(FEATURES, f"ts < TIMESTAMP '{CUTOFF}'", f"ts >= TIMESTAMP '{CUTOFF}'")
DRIFT = with_(TXN, PSI_SQL)


def _report(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    return drift.psi_report(b, c, FEATURES)


@query("drift_report", DRIFT + "SELECT feature, round(psi, 6) AS psi, is_numeric, status FROM rep")
def q_report(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select("feature", A.r6(F.col("psi")).alias("psi"), "is_numeric", "status")


@query("drift_psi_numeric", DRIFT + "SELECT feature, round(psi, 6) AS psi FROM rep WHERE is_numeric")
def q_psi_numeric(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    cols = ["amount", "device_id", "hour", "k", "label"]
    long = drift.to_long(b, cols, "baseline").unionByName(drift.to_long(c, cols, "current"))
    return drift.psi_numeric(long).select("feature", A.r6(F.col("psi")).alias("psi"))


@query("drift_psi_categorical", DRIFT + "SELECT feature, round(psi, 6) AS psi FROM rep WHERE NOT is_numeric")
def q_psi_cat(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    long = drift.to_long(b, ["event_type"], "baseline").unionByName(drift.to_long(c, ["event_type"], "current"))
    return drift.psi_categorical(long).select("feature", A.r6(F.col("psi")).alias("psi"))


@query("drift_feature_type", DRIFT + "SELECT feature, is_numeric FROM types")
def q_feature_type(spark, sf_dir):
    b, c = _sides(spark, sf_dir)
    long = drift.to_long(b, FEATURES, "baseline").unionByName(drift.to_long(c, FEATURES, "current"))
    return drift.feature_types(long)


@query("drift_status", DRIFT + "SELECT status, count(*) AS n_features FROM rep GROUP BY status")
def q_status(spark, sf_dir):
    return drift.status_counts(_report(spark, sf_dir))


@query("topk_drifting_features", DRIFT + """
SELECT feature, round(psi, 6) AS psi, rank FROM (
  SELECT *, row_number() OVER (ORDER BY psi DESC NULLS LAST, feature) AS rank FROM rep) WHERE rank <= 20""")
def q_top_drift(spark, sf_dir):
    t = drift.top_drifting(_report(spark, sf_dir), 20)
    return t.select("feature", A.r6(F.col("psi")).alias("psi"), "rank")


@query("drift_report_lineitem")
def q_report_lineitem(spark, sf_dir):
    """Scale variant: lineitem shipped before / from 1998 (rows-only)."""
    li = read_table(spark, sf_dir, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rep = drift.psi_report(li.where(F.col("l_shipdate") < cut).select(*cols),
                           li.where(F.col("l_shipdate") >= cut).select(*cols), cols)
    return rep.select("feature", A.r6(F.col("psi")).alias("psi"), "status")


# ---------------------------------------------------------------- robustness
def _decide(thr):
    def decide(df):
        d = df.crossJoin(F.broadcast(thr))
        gray = policy.in_gray_zone("p_xgb", XGB_T_LOW, XGB_T_HIGH)
        d = d.withColumn("ae_bucket", policy.ae_bucket(F.when(gray, F.col("ae_err")), "ae_review", "ae_block"))
        return d.select("*", *policy.policy_api("p_xgb", "ae_bucket", XGB_T_LOW, XGB_T_HIGH))
    return decide


def _thr(t):
    from txnguard.operators import calibrate
    return calibrate.percentile_thresholds(t).select(F.col("review").alias("ae_review"), F.col("block").alias("ae_block"))


@query("robust_perturbation")
def q_perturb(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "p_xgb", "ae_err", "label")
    thr = _thr(t)
    p = robust.perturb(t, "txn_id", ["p_xgb", "ae_err"], trials=5, scale=0.2)
    return robust.rescore_flip(t, "txn_id", p, _decide(thr))


@query("robust_extreme_values", with_(TXN, THR) + """
, cases AS (SELECT * FROM (VALUES ('x100', 100.0), ('x_minus100', -100.0), ('zeros', 0.0), ('nan', 'NaN'::DOUBLE)) v(case_name, f)),
x AS (SELECT c.case_name AS case,
             CASE WHEN c.case_name = 'nan' THEN 'NaN'::DOUBLE WHEN c.case_name = 'zeros' THEN 0.0 ELSE p_xgb * c.f END AS p,
             CASE WHEN c.case_name = 'nan' THEN 'NaN'::DOUBLE WHEN c.case_name = 'zeros' THEN 0.0 ELSE ae_err * c.f END AS e
      FROM txn, cases c),
d AS (SELECT x.case, CASE WHEN p < 0.05 THEN 'APPROVE' WHEN p >= 0.8 AND NOT isnan(p) THEN 'BLOCK'
                     WHEN (CASE WHEN p >= 0.05 AND p < 0.8 AND NOT isnan(e) THEN e END) >= thr.ae_block THEN 'BLOCK' ELSE 'REVIEW' END AS decision
      FROM x, thr)
SELECT "case", decision, count(*) AS n, bool_and(decision IN ('APPROVE', 'REVIEW', 'BLOCK')) AS all_valid
FROM d GROUP BY ALL""")
def q_extreme(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "p_xgb", "ae_err")
    x = robust.extreme_values(t, ["p_xgb", "ae_err"])
    d = _decide(_thr(txn(spark, sf_dir)))(x)
    return d.groupBy("case", "decision").agg(F.count(F.lit(1)).alias("n"),
                                             F.bool_and(F.col("decision").isin("APPROVE", "REVIEW", "BLOCK")).alias("all_valid"))


@query("robust_missing_features")
def q_missing(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "p_xgb", "ae_err", "amount", F.col("k").cast("double").alias("k"))
    thr = _thr(txn(spark, sf_dir))
    m = robust.missing_features(t, "txn_id", ["p_xgb", "ae_err", "amount", "k"])
    return robust.rescore_flip(t, "txn_id", m, _decide(thr), group=["fraction"])


@query("robust_boundary")
def q_boundary(spark, sf_dir):
    t = txn(spark, sf_dir).select("txn_id", "p_xgb", "ae_err")
    thr = _thr(txn(spark, sf_dir))
    b = robust.boundary(t, "txn_id", "p_xgb")
    return robust.rescore_flip(t, "txn_id", b, _decide(thr), group=["eps"])
