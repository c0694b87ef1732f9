"""The change fold keeps many stops in one row of state."""

import pandas as pd
from pyspark.sql import functions as F
from test_stateful import day_files, stream

from lagcast.sources import derived
from lagcast.streaming import stateful


def test_state_rows_are_buckets_not_stops(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 3, raising=False)
    folder = tmp_path / "in"
    folder.mkdir()
    day_files(spark, folder, [0, 1], per_day=60)
    rows = stateful.change_states(derived.change_feed(stream(spark, folder)), F.col("ord.ts"))
    query = stateful.save_updates(rows, str(tmp_path / "out"))
    query.awaitTermination()
    assert stateful.newest_updates(spark, str(tmp_path / "out")).count() > 20
    # A value and a timer with its index for each bucket.
    assert 0 < sum(op.numRowsTotal for op in query.lastProgress.stateOperators) <= 4 * 3


def test_newest_values_are_per_attribute():
    rows = pd.DataFrame({"stop_id": ["a", "a", "b"], "event_ms": [5, 9, 2], "x": ["old", None, None], "x_ord": ["1", "2", "3"]})
    got = stateful.newest_values(rows, ["x"]).set_index("stop_id")
    assert got.loc["a", ["event_ms", "x", "x_ord"]].tolist() == [9, "old", "1"]
    assert got.loc["b", "event_ms"] == 2 and pd.isna(got.loc["b", "x"])
