"""Readers of stop events meet stored columns and not the log."""

import os

import pytest

from lagcast import registry
from lagcast.session import configure

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prepared_events_do_not_parse_the_log(spark):
    assert "get_json_object" not in optimized(registry._prepared(configure(spark), FOLDER))


def test_statistics_run_no_lag(spark):
    plan = optimized(registry._stats(configure(spark), FOLDER))
    assert "get_json_object" not in plan and "Window" not in plan


def test_network_runs_do_not_parse_the_log(spark):
    assert "get_json_object" not in optimized(registry._network_runs(configure(spark), FOLDER))
