"""Times on nights of a clock change, and stations that a route names several times."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lagcast.functions import times
from lagcast.operators.transfer import Candidates, propagate_transfer
from lagcast.plans.journeys import transfer_options


@pytest.mark.parametrize(
    "start, minutes, end",
    [
        ("2026-03-29 01:50:00", 30, "2026-03-29 03:20:00"),
        ("2026-03-28 23:00:00", 600, "2026-03-29 10:00:00"),
        ("2026-10-25 01:30:00", 180, "2026-10-25 03:30:00"),
        ("2026-06-01 12:00:00", 75, "2026-06-01 13:15:00"),
    ],
)
def test_minutes_that_pass(spark, start, minutes, end):
    row = spark.range(1).select(F.lit(start).cast("timestamp_ntz").alias("a"), F.lit(end).cast("timestamp_ntz").alias("b"), F.lit(minutes).alias("m"))
    got = row.select(times.plus_minutes(F.col("a"), F.col("m")), times.trip_minutes(F.col("a"), F.col("b")), times.live_minutes(F.col("b"), F.col("a"))).first()
    assert str(got[0]) == end and got[1] == minutes and got[2] == minutes


@pytest.mark.parametrize("leaves, caught", [("2026-03-29 03:05:00", 0.0), ("2026-03-29 03:40:00", 1.0)])
def test_transfer_over_the_skipped_hour(spark, leaves, caught):
    """Planned 01:50, 30 minutes late and 5 to change: ready at 03:25 summer time."""
    planned = datetime.fromisoformat(leaves)
    rows = spark.createDataFrame(
        [("q", c, "RE", "1", None, at, at.replace(hour=at.hour + 2), None, False, 0.0, 10) for c, at in (("a", planned), ("b", planned.replace(hour=5)))],
        "query_id string, cand_id string, category string, number string, line string, dep_planned timestamp_ntz, arr_planned timestamp_ntz, dep_live double, dep_cancelled boolean, cancel_rate double, joint_runs long",
    )
    cells = spark.createDataFrame([("q", c, 0, 0, 10, 10.0) for c in "ab"], "query_id string, cand_id string, dep int, arr int, n int, weight double")
    feeders = spark.createDataFrame([("q", datetime(2026, 3, 29, 1, 50), 5)], "query_id string, feeder_planned timestamp_ntz, transfer_minutes int")
    samples = spark.createDataFrame([("q", 30.0, 1.0)], "query_id string, delay double, mass double")
    out = propagate_transfer(feeders, samples, Candidates(rows, cells))
    assert {r.cand_id: r.board_probability for r in out.candidates.collect()} == pytest.approx({"a": caught, "b": 1 - caught})


def test_a_station_named_again_is_one_option(spark):
    stations = spark.createDataFrame([(str(i), f"Ort {c}", 100 - i) for i, c in enumerate("ABCDEFGHIJKL")], "eva string, name string, weight int")
    path = ["Ort A"] * 9 + ["Ort B", "Ort B"] + [f"Ort {c}" for c in "CDEFGHIJ"]
    departures = spark.createDataFrame(
        [("q", "s", datetime(2026, 1, 1), False, "f", path, "11")],
        "query_id string, stop_id string, dep_planned timestamp_ntz, direct boolean, feeder_id string, dep_path array<string>, to_eva string",
    )
    got = [(r.pick, r.t_name) for r in transfer_options(departures, stations).orderBy("pick").collect()]
    assert got == [(i + 1, f"Ort {c}") for i, c in enumerate("ABCDEFGHIJ")]
