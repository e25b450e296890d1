"""Driver contract: entry runs, every query has a stable schema, oracle
names line up."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF001


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert {r["decision"] for r in rows} <= {"APPROVE", "REVIEW", "BLOCK"}
    assert sum(r["n"] for r in rows) > 0


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 150


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_every_query_plans(spark, name):
    """Every registered query resolves its plan on the smallest tables."""
    assert E.queries()[name](spark, SF001).columns


@pytest.mark.parametrize("name", ["agg_describe", "agg_quantile_exclusive", "cal_percentile_thresholds", "drift_report", "eval_roc_auc",
                                  "explain_reason_details", "flagship_enriched_triage", "join_percentile_vs_baseline", "policy_api",
                                  "store_review_state", "win_time_split", "win_zscore_pit"])
def test_no_job_while_planning(spark, name):
    sc = spark.sparkContext
    sc.setJobGroup("plan-" + name, name)
    try:
        assert E.queries()[name](spark, SF001).columns
        assert not list(sc.statusTracker().getJobIdsForGroup("plan-" + name))
    finally:
        sc.setJobGroup("rest", "")
