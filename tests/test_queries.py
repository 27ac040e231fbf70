"""A few registered queries against their SQL at the smallest scale (all: tests/oracle_check.py)."""
import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["quarantine_reasons", "promotion_days", "event_calendar", "kept_promotions", "weekly_rolling_history", "intermittent_states", "analog_items", "order_review", "same_weekday_lags",
         "planner_baseline", "aggregate_scaling", "node_attributes", "latest_decisions", "launch_ramp", "decision_append", "incremental_ingest", "observed_quality_report", "search_spike_shift"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF).execute(entry.oracle_sql()[name])) == ""


def test_sql_only_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
