"""Queries for the decision log, review event log, feedback and their joins
(SURVEY 2.3, 2.13 and the store parts of 2.5 / 2.6 / 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnguard.catalog import query, scored_txn
from txnguard.functions import scalar
from txnguard.operators import aggregates as A
from txnguard.operators import review, windows
from txnguard.oracles import SCORED, THR, TXN, with_

CUTOFF = "2024-01-16"
# decisions before this day form the existing table of the insert-if-absent queries
EXISTING_CUTOFF = "2024-01-02"


# ---------------------------------------------------------------- bindings
def decisions(spark, sf_dir):
    """Decision log: one row per scored transaction.  The payload is
    (event type, score), so many decisions share a payload hash / review id."""
    s = scored_txn(spark, sf_dir)
    m = F.create_map(F.concat(F.lit("cat__event_type_"), F.col("event_type")), F.lit(1.0).cast("decimal(18,6)"),
                     F.lit("num__p"), F.col("p_xgb").cast("decimal(18,6)"))
    h = scalar.payload_hash(m)
    rid = scalar.review_id(h)
    path = F.when((F.col("decision") == "REVIEW") & (F.pmod(F.col("txn_id"), F.lit(4)) != 1),
                  F.concat(F.lit("features/"), rid, F.lit(".json"))).otherwise(F.lit(""))
    version = F.when(F.col("ts") < F.lit(CUTOFF).cast("timestamp"), "xgb-v1").otherwise("xgb-feedback-2024w03")
    return s.select(F.col("txn_id").alias("id"), F.col("epoch_s").alias("created"), "decision",
                    h.alias("payload_hash"), rid.alias("review_id"), F.col("p_xgb").alias("score_xgb"),
                    F.col("ae_err_g").alias("ae_error"), "ae_bucket", "reason_codes", path.alias("feature_path"),
                    "txn_id", F.col("ts").alias("timestamp"), version.alias("model_version"), "label", "k",
                    "amount", "event_type")


def opened_reviews(dec):
    """First REVIEW decision per review id (first wins; skew-safe min_by)."""
    from txnguard.plans.scale import first_per_key
    return first_per_key(dec.where(F.col("decision") == "REVIEW"), ["review_id"], ["created", "id"]).select(*dec.columns)


def review_events(dec, named=False):
    """Event log of the opened reviews, generated in one pass: every review
    row emits an array of its events, exploded (no per-event-type rescans)."""
    rv = opened_reviews(dec)
    c = F.col
    n = F.lit(None)

    def ev(cond, seq, dt, typ, analyst=n, decision=n, notes=n, score=n, err=n, bucket=n, shap=n):
        e = F.struct(F.lit(seq).cast("long").alias("event_seq"), (c("created") + dt).cast("long").alias("ts"),
                     F.lit(typ).alias("event_type"), analyst.cast("string").alias("analyst"),
                     decision.cast("string").alias("decision"), notes.cast("string").alias("notes"),
                     score.cast("double").alias("score_xgb"), err.cast("double").alias("ae_error"),
                     bucket.cast("string").alias("ae_bucket"), shap.cast("string").alias("shap_path"))
        return F.when(cond, e)

    def every(m):
        return F.pmod(c("txn_id"), F.lit(m)) == 0
    events = F.array_compact(F.array(
        ev(F.lit(True), 0, 0, "opened", score=c("score_xgb"), err=c("ae_error"), bucket=c("ae_bucket")),
        ev(every(2), 1, 60, "assigned", analyst=F.concat(F.lit("analyst_"), F.pmod(c("txn_id"), F.lit(5)).cast("string"))),
        ev(every(7), 2, 120, "shap_attached", shap=F.concat(F.lit("shap/"), c("review_id"), F.lit(".png"))),
        ev(every(5), 3, 1800, "rescored", score=F.least(F.lit(1.0), c("score_xgb") + 0.01), err=c("ae_error") * 1.1,
           bucket=c("ae_bucket")),
        ev(every(3), 4, 3600, "closed", decision=F.when(c("label") == 1, "BLOCK").otherwise("APPROVE"),
           notes=F.lit("closed by analyst"),
           analyst=F.when(every(9), F.concat(F.lit("closer_"), F.pmod(c("txn_id"), F.lit(2)).cast("string"))) if named else n),
        ev(every(6), 5, 7200, "assigned", analyst=F.lit("late_analyst"))))
    known = rv.select("review_id", F.explode(events).alias("e")).select("review_id", "e.*")
    unknown_src = dec.where((c("decision") == "APPROVE") & every(50))
    unknown = unknown_src.select(F.concat(F.lit("rev_missing_"), c("txn_id").cast("string")).alias("review_id"),
                                 ev(F.lit(True), 4, 3600, "closed", decision=F.lit("BLOCK"),
                                    notes=F.lit("unknown review")).alias("e")).select("review_id", "e.*")
    return known.unionByName(unknown)


STORE_SQL = """dec AS (
  SELECT txn_id AS id, epoch_s AS created, decision,
         sha256('cat__event_type_' || event_type || '=1.000000|num__p=' || CAST(CAST(p_xgb AS DECIMAL(18, 6)) AS VARCHAR))
           AS payload_hash,
         p_xgb AS score_xgb, ae_err_g AS ae_error, ae_bucket, reason_codes, txn_id, ts AS timestamp,
         CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'xgb-v1' ELSE 'xgb-feedback-2024w03' END AS model_version,
         label, k, amount, event_type
  FROM scored),
dec2 AS (
  SELECT *, 'rev_' || substr(payload_hash, 1, 16) AS review_id,
         CASE WHEN decision = 'REVIEW' AND txn_id % 4 <> 1 THEN 'features/rev_' || substr(payload_hash, 1, 16) || '.json'
              ELSE '' END AS feature_path
  FROM dec),
rv AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY created, id) AS rn
                          FROM dec2 WHERE decision = 'REVIEW') WHERE rn = 1),
ev AS (
  SELECT review_id, CAST(0 AS BIGINT) AS event_seq, created AS ts, 'opened' AS event_type, CAST(NULL AS VARCHAR) AS analyst,
         CAST(NULL AS VARCHAR) AS decision, CAST(NULL AS VARCHAR) AS notes, score_xgb, ae_error, ae_bucket,
         CAST(NULL AS VARCHAR) AS shap_path FROM rv
  UNION ALL SELECT review_id, 1, created + 60, 'assigned', 'analyst_' || CAST(txn_id % 5 AS VARCHAR), NULL, NULL, NULL, NULL,
         NULL, NULL FROM rv WHERE txn_id % 2 = 0
  UNION ALL SELECT review_id, 2, created + 120, 'shap_attached', NULL, NULL, NULL, NULL, NULL, NULL,
         'shap/' || review_id || '.png' FROM rv WHERE txn_id % 7 = 0
  UNION ALL SELECT review_id, 3, created + 1800, 'rescored', NULL, NULL, NULL, least(1.0, score_xgb + 0.01), ae_error * 1.1,
         ae_bucket, NULL FROM rv WHERE txn_id % 5 = 0
  UNION ALL SELECT review_id, 4, created + 3600, 'closed', NULL, CASE WHEN label = 1 THEN 'BLOCK' ELSE 'APPROVE' END,
         'closed by analyst', NULL, NULL, NULL, NULL FROM rv WHERE txn_id % 3 = 0
  UNION ALL SELECT review_id, 5, created + 7200, 'assigned', 'late_analyst', NULL, NULL, NULL, NULL, NULL, NULL
         FROM rv WHERE txn_id % 6 = 0
  UNION ALL SELECT 'rev_missing_' || CAST(txn_id AS VARCHAR), 4, created + 3600, 'closed', NULL, 'BLOCK', 'unknown review',
         NULL, NULL, NULL, NULL FROM dec2 WHERE decision = 'APPROVE' AND txn_id % 50 = 0),
evo AS (
  SELECT *, ts * 100 + event_seq AS ord,
         min(CASE WHEN event_type = 'closed' THEN ts * 100 + event_seq END) OVER (PARTITION BY review_id) AS fc FROM ev),
st AS (
  SELECT review_id,
    CASE WHEN count(*) FILTER (WHERE event_type = 'closed') > 0 THEN 'closed' ELSE 'open' END AS status,
    arg_max_null(analyst, ord) FILTER (WHERE event_type = 'assigned' AND (fc IS NULL OR ord < fc)) AS analyst,
    arg_max_null(decision, ord) FILTER (WHERE event_type = 'closed') AS analyst_decision,
    arg_max_null(notes, ord) FILTER (WHERE event_type = 'closed') AS notes,
    arg_max_null(score_xgb, ord) FILTER (WHERE event_type IN ('opened', 'rescored')) AS score_xgb,
    arg_max_null(ae_error, ord) FILTER (WHERE event_type IN ('opened', 'rescored')) AS ae_error,
    arg_max_null(ae_bucket, ord) FILTER (WHERE event_type IN ('opened', 'rescored')) AS ae_bucket,
    arg_max_null(shap_path, ord) FILTER (WHERE event_type = 'shap_attached') AS shap_path,
    min(ts) FILTER (WHERE event_type = 'opened') AS created, max(ts) AS updated
  FROM evo GROUP BY review_id HAVING count(*) FILTER (WHERE event_type = 'opened') > 0),
opened_ids AS (SELECT DISTINCT review_id FROM ev WHERE event_type = 'opened'),
fb AS (
  SELECT 'fb-' || e.review_id || '-' || CAST(e.event_seq AS VARCHAR) AS id, e.ts AS created, e.review_id,
         upper(trim(e.decision)) AS outcome, e.notes
  FROM ev e SEMI JOIN opened_ids o ON e.review_id = o.review_id
  WHERE e.event_type = 'closed' AND upper(trim(e.decision)) IN ('APPROVE', 'BLOCK'))"""

ST = with_(TXN, THR, SCORED, STORE_SQL)


def state(spark, sf_dir):
    return review.fold_review_state(review_events(decisions(spark, sf_dir)))


# ---------------------------------------------------------------- queries
@query("store_log_decision", ST + """
SELECT id, created, decision, payload_hash, score_xgb, ae_error, ae_bucket, reason_codes,
       feature_path, model_version FROM dec2""")
def q_log_decision(spark, sf_dir):
    d = decisions(spark, sf_dir)
    return d.select("id", "created", "decision", "payload_hash", "score_xgb", "ae_error", "ae_bucket",
                    F.array_join("reason_codes", ",").alias("reason_codes"), "feature_path", "model_version")


@query("store_open_review", ST + """
, b AS (SELECT * FROM dec2 WHERE decision = 'REVIEW' AND timestamp >= TIMESTAMP '2024-01-02'),
ex AS (SELECT DISTINCT review_id FROM dec2 WHERE decision = 'REVIEW' AND timestamp < TIMESTAMP '2024-01-02'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY created, id) AS rn FROM b) WHERE rn = 1)
SELECT review_id, id, created FROM f ANTI JOIN ex USING (review_id)""")
def q_open_review(spark, sf_dir):
    d = decisions(spark, sf_dir).where(F.col("decision") == "REVIEW")
    cut = F.lit(EXISTING_CUTOFF).cast("timestamp")
    new = review.insert_if_absent(d.where(F.col("timestamp") >= cut), d.where(F.col("timestamp") < cut),
                                  "review_id", ["created", "id"])
    return new.select("review_id", "id", "created")


@query("join_insert_if_absent", ST + """
, b AS (SELECT * FROM dec2 WHERE timestamp >= TIMESTAMP '2024-01-02'),
ex AS (SELECT DISTINCT payload_hash FROM dec2 WHERE timestamp < TIMESTAMP '2024-01-02'),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY payload_hash ORDER BY created, id) AS rn FROM b) WHERE rn = 1)
SELECT payload_hash, id FROM f ANTI JOIN ex USING (payload_hash)""")
def q_insert_if_absent(spark, sf_dir):
    d = decisions(spark, sf_dir)
    cut = F.lit(EXISTING_CUTOFF).cast("timestamp")
    new = review.insert_if_absent(d.where(F.col("timestamp") >= cut), d.where(F.col("timestamp") < cut),
                                  "payload_hash", ["created", "id"])
    return new.select("payload_hash", "id")


@query("store_close_review", ST + """
SELECT review_id, ts, decision, review_id IN (SELECT review_id FROM opened_ids) AS accepted FROM ev WHERE event_type = 'closed'""")
def q_close_review(spark, sf_dir):
    ev = review_events(decisions(spark, sf_dir))
    acc, rej = review.reject_unknown(ev, "closed")
    return (acc.select("review_id", "ts", "decision", F.lit(True).alias("accepted"))
            .unionByName(rej.select("review_id", "ts", "decision", F.lit(False).alias("accepted"))))


@query("store_assign_review", ST + "SELECT review_id, analyst FROM st")
def q_assign(spark, sf_dir):
    return state(spark, sf_dir).select("review_id", "analyst")


@query("store_rescore_review", ST + """
SELECT review_id, round(score_xgb, 6) AS score_xgb, round(ae_error, 6) AS ae_error, ae_bucket FROM st""")
def q_rescore(spark, sf_dir):
    return state(spark, sf_dir).select("review_id", A.r6(F.col("score_xgb")).alias("score_xgb"),
                                       A.r6(F.col("ae_error")).alias("ae_error"), "ae_bucket")


@query("store_attach_explanation", ST + "SELECT review_id, shap_path, status FROM st")
def q_attach(spark, sf_dir):
    return state(spark, sf_dir).select("review_id", "shap_path", "status")


@query("store_review_state", ST + """
SELECT review_id, status, analyst, analyst_decision, notes, round(score_xgb, 6) AS score_xgb, round(ae_error, 6) AS ae_error,
       ae_bucket, shap_path, created, updated FROM st""")
def q_state(spark, sf_dir):
    s = state(spark, sf_dir)
    return s.select("review_id", "status", "analyst", "analyst_decision", "notes",
                    A.r6(F.col("score_xgb")).alias("score_xgb"), A.r6(F.col("ae_error")).alias("ae_error"),
                    "ae_bucket", "shap_path", "created", "updated")


@query("store_add_feedback", ST + "SELECT * FROM fb")
def q_add_feedback(spark, sf_dir):
    return review.feedback_rows(review_events(decisions(spark, sf_dir)))


@query("agg_feedback_summary", ST + """
SELECT outcome, count(*) AS n, (SELECT count(*) FROM fb) AS total_feedback,
       (SELECT count(*) FROM st WHERE status = 'closed') AS closed_reviews FROM fb GROUP BY outcome""")
def q_feedback_summary(spark, sf_dir):
    ev = review_events(decisions(spark, sf_dir))
    return review.feedback_summary(review.feedback_rows(ev), review.fold_review_state(ev))


@query("store_export_feedback", ST + """
SELECT review_id, analyst_decision, CASE upper(trim(analyst_decision)) WHEN 'BLOCK' THEN 1 WHEN 'APPROVE' THEN 0 END AS label,
       updated FROM st WHERE status = 'closed' AND analyst_decision IS NOT NULL
ORDER BY updated DESC, review_id DESC LIMIT 200""")
def q_export(spark, sf_dir):
    e = review.export_feedback(state(spark, sf_dir), 200)
    return e.select("review_id", "analyst_decision", "label", "updated")


@query("store_export_feedback_all", ST + """
SELECT review_id, analyst_decision, CASE upper(trim(analyst_decision)) WHEN 'BLOCK' THEN 1 WHEN 'APPROVE' THEN 0 END AS label,
       updated FROM st WHERE status = 'closed' AND upper(trim(analyst_decision)) IN ('APPROVE', 'BLOCK')""")
def q_export_all(spark, sf_dir):
    """Every labelled review."""
    return review.export_feedback(state(spark, sf_dir)).select("review_id", "analyst_decision", "label", "updated")


NAMED_SQL = STORE_SQL.replace("'closed', NULL, CASE WHEN label", "'closed', CASE WHEN txn_id % 9 = 0 THEN 'closer_' || CAST(txn_id % 2 AS VARCHAR) END, "
                              "CASE WHEN label").replace(
    "FILTER (WHERE event_type = 'assigned' AND (fc IS NULL OR ord < fc)) AS analyst",
    "FILTER (WHERE event_type = 'assigned' AND (fc IS NULL OR ord < fc) OR event_type = 'closed' AND analyst IS NOT NULL) AS analyst")


@query("store_close_review_named", with_(TXN, THR, SCORED, NAMED_SQL) + "SELECT review_id, status, analyst, analyst_decision, updated FROM st")
def q_close_named(spark, sf_dir):
    """State where some closes name their analyst, who then holds the review."""
    ev = review_events(decisions(spark, sf_dir), named=True)
    return review.fold_review_state(ev).select("review_id", "status", "analyst", "analyst_decision", "updated")


def snapshots(dec):
    """Feature snapshot table keyed by feature path (one row per written
    snapshot): the exact scored features of the review's decision."""
    rv = opened_reviews(dec).where(F.col("feature_path") != "")
    return rv.select("feature_path", F.col("amount").alias("num__amount"), F.col("score_xgb").alias("num__p"),
                     F.col("k").cast("double").alias("num__k"))


SNAP_SQL = """snap AS (SELECT feature_path, amount AS num__amount, score_xgb AS num__p, CAST(k AS DOUBLE) AS num__k
                FROM rv WHERE feature_path <> '')"""


@query("store_feedback_dataset", with_(TXN, THR, SCORED, STORE_SQL, SNAP_SQL) + """
SELECT s.review_id, CASE upper(trim(analyst_decision)) WHEN 'BLOCK' THEN 1 WHEN 'APPROVE' THEN 0 END AS label,
       num__amount, num__p, num__k
FROM st s JOIN rv r USING (review_id) JOIN snap USING (feature_path)
WHERE s.status = 'closed' AND s.analyst_decision IS NOT NULL""")
def q_feedback_dataset(spark, sf_dir):
    d = decisions(spark, sf_dir)
    st = review.fold_review_state(review_events(d))
    rv = opened_reviews(d).select("review_id", "feature_path")
    closed = (st.where((F.col("status") == "closed") & F.col("analyst_decision").isNotNull())
              .select("review_id", scalar.outcome_label("analyst_decision").alias("label")))
    ds = closed.join(rv, "review_id").join(snapshots(d), "feature_path")
    feats = ["num__amount", "num__p", "num__k"]
    from txnguard.operators.quality import no_nulls_gate  # noqa: F401  (schema gate lives in quality)
    return ds.select("review_id", "label", *feats)


@query("join_review_snapshot", with_(TXN, THR, SCORED, STORE_SQL, SNAP_SQL) + """
SELECT review_id, feature_path, num__amount, num__p FROM rv JOIN snap USING (feature_path)""")
def q_review_snapshot(spark, sf_dir):
    d = decisions(spark, sf_dir)
    rv = opened_reviews(d).select("review_id", "feature_path")
    return rv.join(snapshots(d), "feature_path").select("review_id", "feature_path", "num__amount", "num__p")


@query("join_backfill_latest", ST + """
, latest AS (SELECT payload_hash, feature_path AS lp FROM (SELECT *, row_number() OVER (PARTITION BY payload_hash
             ORDER BY created DESC, id DESC) AS rn FROM dec2) WHERE rn = 1),
j AS (SELECT r.review_id, r.feature_path, s.status, s.analyst_decision, l.lp FROM rv r JOIN st s USING (review_id)
      LEFT JOIN latest l USING (payload_hash))
SELECT review_id, CASE WHEN status = 'closed' AND analyst_decision IS NOT NULL AND coalesce(trim(feature_path), '') = ''
                        AND coalesce(trim(lp), '') <> '' THEN lp ELSE feature_path END AS feature_path FROM j""")
def q_backfill(spark, sf_dir):
    d = decisions(spark, sf_dir)
    st = review.fold_review_state(review_events(d)).select("review_id", "status", "analyst_decision")
    rv = opened_reviews(d).select("review_id", "payload_hash", "feature_path").join(st, "review_id")
    return review.backfill_latest_path(rv, d).select("review_id", "feature_path")


@query("join_feedback_review_exists", ST + """
SELECT review_id, event_seq, review_id IN (SELECT review_id FROM opened_ids) AS review_exists
FROM ev WHERE event_type = 'closed'""")
def q_feedback_exists(spark, sf_dir):
    ev = review_events(decisions(spark, sf_dir))
    labels = ev.where(F.col("event_type") == "closed").select("review_id", "event_seq")
    opened = ev.where(F.col("event_type") == "opened").select("review_id").distinct()
    ok = labels.join(opened, "review_id", "left_semi").withColumn("review_exists", F.lit(True))
    bad = labels.join(opened, "review_id", "left_anti").withColumn("review_exists", F.lit(False))
    return ok.unionByName(bad)


def registry_config(dec):
    """The version of the newest decision (by created, then id) and their number."""
    return dec.agg(F.max_by("model_version", F.struct("created", "id")).alias("active_version"),
                   F.count(F.lit(1)).alias("n_decisions"))


@query("join_registry_config", ST + """
, cfg AS (SELECT arg_max(model_version, created * 100000 + id) AS active_version, count(*) AS n_decisions FROM dec2)
SELECT id, model_version, active_version, model_version = active_version AS is_active FROM dec2, cfg""")
def q_registry(spark, sf_dir):
    d = decisions(spark, sf_dir)
    cfg = registry_config(d)  # one row: broadcast
    return d.crossJoin(F.broadcast(cfg)).select("id", "model_version", "active_version",
                                                (F.col("model_version") == F.col("active_version")).alias("is_active"))


@query("join_registry_config_newest", ST + """
, cfg AS (SELECT arg_max(model_version, (created, id)) AS active_version, count(*) AS n_decisions FROM dec2)
SELECT id, model_version, active_version, model_version = active_version AS is_active FROM dec2, cfg""")
def q_registry_newest(spark, sf_dir):
    """As ``join_registry_config``, held against an order that is right for any id."""
    return q_registry(spark, sf_dir)


@query("filter_review_view", ST + """
SELECT review_id, CASE WHEN analyst_decision IS NULL THEN 'open' WHEN analyst_decision = 'APPROVE' THEN 'approved'
                       WHEN analyst_decision = 'BLOCK' THEN 'blocked' END AS view FROM st""")
def q_review_view(spark, sf_dir):
    s = state(spark, sf_dir)
    views = [("open", F.col("analyst_decision").isNull()), ("approved", F.col("analyst_decision") == "APPROVE"),
             ("blocked", F.col("analyst_decision") == "BLOCK")]
    out = None
    for name, cond in views:
        part = s.where(cond).select("review_id", F.lit(name).alias("view"))
        out = part if out is None else out.unionByName(part)
    return out


@query("topk_review_queue", ST + """
SELECT review_id, status, created FROM st WHERE status = 'open' ORDER BY created DESC, review_id DESC LIMIT 200""")
def q_queue(spark, sf_dir):
    return review.review_queue(state(spark, sf_dir), "open", 200).select("review_id", "status", "created")


@query("topk_feedback_events", ST + "SELECT id, created, review_id, outcome FROM fb ORDER BY created DESC, id DESC LIMIT 50")
def q_feedback_top(spark, sf_dir):
    fb = review.feedback_rows(review_events(decisions(spark, sf_dir)))
    return fb.orderBy(F.col("created").desc(), F.col("id").desc()).limit(50).select("id", "created", "review_id", "outcome")


@query("win_latest_per_key", ST + """
SELECT payload_hash, id FROM (SELECT *, row_number() OVER (PARTITION BY payload_hash ORDER BY created DESC, id DESC) AS rn
                              FROM dec2) WHERE rn = 1""")
def q_latest(spark, sf_dir):
    return windows.latest_per_key(decisions(spark, sf_dir), "payload_hash", ["created", "id"]).select("payload_hash", "id")


@query("store_select_suspect_scores", ST + """
SELECT review_id, score_xgb, ae_bucket FROM st
WHERE score_xgb IS NULL OR score_xgb = 0.5 OR trim(coalesce(ae_bucket, '')) = '' OR lower(trim(ae_bucket)) = 'unknown'""")
def q_suspect(spark, sf_dir):
    return review.suspect_scores(state(spark, sf_dir)).select("review_id", "score_xgb", "ae_bucket")


@query("store_fix_versions", ST + """
, raw AS (SELECT id, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN strftime(timestamp, '%Y-%m-%d %H:%M:%S')
                        ELSE model_version END AS v FROM dec2)
SELECT id, CASE WHEN trim(coalesce(v, '')) = '' OR regexp_matches(trim(coalesce(v, '')), '^\\d{4}-\\d{2}-\\d{2}([ T]\\d{2}:\\d{2}(:\\d{2})?)?')
                THEN 'xgb-v1' ELSE trim(coalesce(v, '')) END AS model_version FROM raw""")
def q_fix_versions(spark, sf_dir):
    d = decisions(spark, sf_dir)
    raw = (F.when(F.pmod("id", F.lit(4)) == 0, F.lit(None).cast("string")).when(F.pmod("id", F.lit(4)) == 1, F.lit("  "))
           .when(F.pmod("id", F.lit(4)) == 2, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
           .otherwise(F.col("model_version")))
    return d.select("id", review.fix_version(raw).alias("model_version"))


@query("store_schema_evolve")
def q_schema_evolve(spark, sf_dir):
    """Old decision rows (no model_version / reason columns) unioned with
    new ones; rows-only check (schema behaviour is tested in pytest)."""
    d = decisions(spark, sf_dir)
    cut = F.lit(CUTOFF).cast("timestamp")
    old = d.where(F.col("timestamp") < cut).select("id", "created", "decision", "score_xgb")
    new = d.where(F.col("timestamp") >= cut).select("id", "created", "decision", "score_xgb", "model_version", "ae_bucket")
    return review.evolve_schema(old, new)
