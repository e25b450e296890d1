"""Review queue and feedback tables as append-only logs folded to state.

The reference mutates SQLite rows (open, assign, close, rescore, attach an
explanation).  Parquet has no UPDATE, and concurrent writers would race, so
every change is an appended *event* ``(review_id, event_seq, ts,
event_type, ...)`` and the current state is a fold: one ``groupBy`` with
``max_by`` per field, ordered by ``(ts, event_seq)`` encoded as one long.
Appends are idempotent per micro-batch id, so a lost executor or a replayed
batch cannot double-apply a change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnguard.functions.scalar import strip_space

EVENT_TYPES = ("opened", "assigned", "shap_attached", "rescored", "closed")
SCORE_FIELDS = ("score_xgb", "ae_error", "ae_bucket")


def event_order(ts_epoch: str = "ts", seq: str = "event_seq") -> Column:
    """Total order of events of one review: time, then sequence number."""
    return F.struct(F.col(ts_epoch).cast("long").alias("ts"), F.col(seq).cast("long").alias("seq"))


def fold_review_state(events: DataFrame) -> DataFrame:
    """Current state of every opened review.

    * status: ``closed`` once any close exists (a close from any status);
    * analyst: who closed it, if the close names one, else the last assignment
      made while the review was still open;
    * analyst decision / notes: the last close;
    * scores: the last of opened / rescored;
    * shap_path: the last explanation attached (no status change).
    """
    e = events.withColumn("__ord", event_order())
    # first close per review: a partial aggregate joined back (a hot review
    # is split by AQE's skew join instead of landing in one window task)
    fc = e.where(F.col("event_type") == "closed").groupBy("review_id").agg(F.min("__ord").alias("__first_close"))
    e = e.join(fc, "review_id", "left")
    t = F.col("event_type")

    def last(col: str, cond: Column) -> Column:
        return F.max_by(F.col(col), F.when(cond, F.col("__ord")))
    open_assign = (t == "assigned") & (F.col("__first_close").isNull() | (F.col("__ord") < F.col("__first_close")))
    scored = t.isin("opened", "rescored")
    st = e.groupBy("review_id").agg(
        F.count_if(t == "opened").alias("__opened"),
        F.when(F.count_if(t == "closed") > 0, "closed").otherwise("open").alias("status"),
        last("analyst", open_assign | ((t == "closed") & F.col("analyst").isNotNull())).alias("analyst"),
        last("decision", t == "closed").alias("analyst_decision"),
        last("notes", t == "closed").alias("notes"),
        *[last(c, scored).alias(c) for c in SCORE_FIELDS],
        last("shap_path", t == "shap_attached").alias("shap_path"),
        F.min(F.when(t == "opened", F.col("ts"))).alias("created"),
        F.max("ts").alias("updated"))
    return st.where(F.col("__opened") > 0).drop("__opened")


def reject_unknown(events: DataFrame, event_type: str) -> tuple[DataFrame, DataFrame]:
    """Split events of ``event_type`` into (accepted, rejected): rejected
    when the review was never opened (left anti join)."""
    opened = events.where(F.col("event_type") == "opened").select("review_id").distinct()
    ev = events.where(F.col("event_type") == event_type)
    return ev.join(opened, "review_id", "left_semi"), ev.join(opened, "review_id", "left_anti")


def insert_if_absent(batch: DataFrame, existing: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is not in ``existing``; inside the batch
    the first row per key (by ``order``) wins."""
    from txnguard.plans.scale import first_per_key
    first = first_per_key(batch, [key], order)
    return first.join(existing.select(key).distinct(), key, "left_anti")


def feedback_rows(events: DataFrame) -> DataFrame:
    """One feedback row per accepted close with outcome APPROVE / BLOCK.
    The id includes review and sequence, so two closes in one second never
    collide."""
    closes, _ = reject_unknown(events, "closed")
    return closes.where(F.upper(strip_space("decision")).isin("APPROVE", "BLOCK")).select(
        F.concat_ws("-", F.lit("fb"), F.col("review_id"), F.col("event_seq").cast("string")).alias("id"),
        F.col("ts").alias("created"), "review_id", F.upper(strip_space("decision")).alias("outcome"), "notes")


def feedback_summary(feedback: DataFrame, state: DataFrame) -> DataFrame:
    by = feedback.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
    tot = feedback.agg(F.count(F.lit(1)).alias("total_feedback"))
    closed = state.agg(F.count_if(F.col("status") == "closed").alias("closed_reviews"))
    return by.crossJoin(tot).crossJoin(closed)


def export_feedback(state: DataFrame, limit: int | None = None) -> DataFrame:
    """Closed and decided reviews with the label (BLOCK -> 1, APPROVE -> 0): all
    of them, or with a ``limit`` (a top-k report) the last updated ones."""
    from txnguard.functions.scalar import outcome_label
    d = state.where((F.col("status") == "closed") & F.col("analyst_decision").isNotNull())
    d = d.withColumn("label", outcome_label("analyst_decision")).where(F.col("label").isNotNull())
    return d if limit is None else d.orderBy(F.col("updated").desc(), F.col("review_id").desc()).limit(limit)


def review_queue(state: DataFrame, status: str | None = None, limit: int = 200) -> DataFrame:
    """Queue view: open/all newest created first, closed newest updated first."""
    d = state if status is None else state.where(F.col("status") == status)
    key = "updated" if status == "closed" else "created"
    return d.orderBy(F.col(key).desc(), F.col("review_id").desc()).limit(limit)


def backfill_latest_path(reviews: DataFrame, decisions: DataFrame) -> DataFrame:
    """For closed labelled reviews with a blank feature path, take the path
    of the latest decision with the same payload hash; a blank latest path
    stays blank (no fallback to older decisions)."""
    from txnguard.plans.scale import first_per_key
    latest = (first_per_key(decisions.select("payload_hash", "created", "id", "feature_path"), ["payload_hash"],
                            ["created", "id"], latest=True)
              .select("payload_hash", F.col("feature_path").alias("__latest_path")))
    blank = F.coalesce(strip_space(F.col("feature_path")), F.lit("")) == ""
    need = (F.col("status") == "closed") & F.col("analyst_decision").isNotNull() & blank
    j = reviews.join(latest, "payload_hash", "left")
    return j.withColumn("feature_path", F.when(need & (F.coalesce(strip_space("__latest_path"), F.lit("")) != ""),
                                               F.col("__latest_path")).otherwise(F.col("feature_path"))
                        ).drop("__latest_path")


def suspect_scores(state: DataFrame) -> DataFrame:
    b = strip_space(F.coalesce(F.col("ae_bucket"), F.lit("")))
    return state.where(F.col("score_xgb").isNull() | (F.col("score_xgb") == 0.5) | (b == "") | (F.lower(b) == "unknown"))


def fix_version(v: Column) -> Column:
    """Null/blank or timestamp-like version -> ``xgb-v1``."""
    s = strip_space(F.coalesce(v, F.lit("")))
    ts_like = s.rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?")
    return F.when((s == "") | ts_like, F.lit("xgb-v1")).otherwise(s)


def evolve_schema(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows gain columns added later (null), new rows keep theirs."""
    return old.unionByName(new, allowMissingColumns=True)
