"""Scale properties of the physical plans, kept from regressing."""

from __future__ import annotations

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

Q = E.queries()


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _scans(plan: str, first_col: str) -> int:
    return plan.count(f"FileScan parquet [{first_col}")


@pytest.mark.parametrize("name", ["recent_activity", "txn_enriched", "loans_list", "fraud_alerts_list"])
def test_list_top_k_is_pinned_not_recomputed(spark, name):
    """The final plan reads the pinned top-k, never the fact table again."""
    plan = _plan(Q[name](spark, SF_SMALL))
    assert "TakeOrderedAndProject" not in plan
    assert _scans(plan, "o_orderkey") == 0 and _scans(plan, "l_orderkey") == 0


def test_bulk_update_reads_the_base_once(spark):
    plan = _plan(Q["update_by_key"](spark, SF_SMALL))
    assert _scans(plan, "o_orderkey") == 1
    assert _scans(plan, "event_id") == 1


@pytest.mark.parametrize("name", ["fraud_geographic", "fraud_duplicate"])
def test_fraud_windows_read_and_shuffle_ordinary_rows_once(spark, name):
    plan = _plan(Q[name](spark, SF_SMALL))
    assert _scans(plan, "event_id") == 1
    assert plan.count("Exchange hashpartitioning") == 1


def test_reports_start_no_job_while_they_are_built(spark):
    """Lists pin one top-k; reports are lazy plans."""
    tracker = spark.sparkContext.statusTracker()
    for name, most in (("key_constraints_report", 0), ("orphan_report", 0), ("branch_kpi_rollup", 0), ("txn_enriched", 2),
                       ("recent_activity", 2), ("customer_accounts_nested", 2)):
        group = f"build-{name}"
        spark.sparkContext.setJobGroup(group, name)
        Q[name](spark, SF_SMALL)
        assert len(tracker.getJobIdsForGroup(group)) <= most, name
    spark.sparkContext.setJobGroup("rest", "rest")


def test_stored_time_window_prunes_partitions(spark):
    plan = _plan(Q["daily_transactions_stored"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(transaction_date" in plan


def test_lookups_broadcast_the_bounded_keys(spark):
    plan = _plan(Q["customer_accounts_nested"](spark, SF_SMALL))
    assert "BroadcastExchange" in plan


def test_stream_triggers_join_nothing(spark):
    """Lookups happen when a sink is read, not in every micro-batch."""
    from vaultline.streaming import jobs as J
    ev = J.event_stream(spark, SF_SMALL)
    s = J.high_risk_alerts_stream(ev)
    assert "Join" not in s._jdf.queryExecution().analyzed().toString()


def test_velocity_shuffles_panes_not_windows(bank):
    """One exchange of partial panes and one of panes; windows are summed where these lie."""
    from vaultline.operators import fraud as FR
    text = FR.fraud_velocity(bank.event_transactions)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2, text
