"""Plan and change streams meet in one fold; readers of stop events leave the log alone."""

import pytest
from pyspark.sql import functions as F
from test_stateful import day_files

from lagcast.sources import derived
from lagcast.streaming import stateful


@pytest.fixture(scope="module")
def nation(spark):
    return spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string")


def test_a_stop_of_both_feeds_costs_one_row_of_state(spark, tmp_path, nation):
    folder = tmp_path / "in"
    folder.mkdir()
    day_files(spark, folder, [0])
    log = spark.read.parquet(str(folder))
    stops = [f.select("stop_id") for f in (derived.plan_feed(log, nation).filter("labelled"), derived.change_feed(log))]
    feed = derived.event_stream(spark, str(folder), "*.parquet")
    joined = stateful.stop_events(derived.plan_feed(feed, nation), derived.change_feed(feed), F.col("ord.ts"), F.col("ord.ts"))
    query = stateful.save_updates(joined, str(tmp_path / "out"), mode="append")
    query.awaitTermination()
    operators = query.lastProgress.stateOperators
    assert len(operators) == 1
    assert operators[0].numRowsTotal == stops[0].unionByName(stops[1]).distinct().count()
