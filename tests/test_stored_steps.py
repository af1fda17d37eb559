"""What is read more than once is stored: no later step goes back to the flows."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["anomaly_groups", "detect_all"])
def test_results_read_stored_steps(spark, name):
    assert not [f for f in entry.queries()[name](spark, FOLDER).inputFiles() if f.endswith("/events.parquet")]


def test_off_hours_lists_are_ranked_in_one_table(spark):
    plan = entry.queries()["off_hours_sources"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Window [") == 1


def test_features_join_no_rows(spark):
    plan = entry.queries()["ml_features"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window [" not in plan and plan.count("Join ") == 1      # with what each part must add: one row a part
