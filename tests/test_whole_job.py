"""Registered queries and planners do the whole job by default, without budgets."""

import random
from datetime import datetime, time, timedelta

import pytest
from test_models import TODAY, runs_of

from lagcast import registry, schemas
from lagcast.operators import boards
from lagcast.plans import backtest, connections, journeys
from lagcast.session import materialize

NOON = datetime.combine(TODAY, time(12))


def test_backtest_queries_score_eight_weeks_and_every_variant(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("1", "ICE", "5", TODAY - timedelta(days=ago), 600, rng.randint(0, 9), rng.randint(0, 9)) for ago in range(80)]
    df = spark.createDataFrame(rows, "eva string, train_type string, train_number string, day date, tod int, delay int, prev int")
    monkeypatch.setattr(registry, "_evaluation", lambda spark, d: df)
    days = {str(TODAY - timedelta(days=ago)) for ago in range(57)}
    pairs = registry.QUERIES["backtest_pairs"](spark, "").collect()
    assert {r.day for r in pairs} == days and len(pairs) == 57
    scored = registry.QUERIES["backtest_crps"](spark, "").select("variant", "scenario", "day").collect()
    names = {v.name for v in backtest.VARIANTS}
    assert {tuple(r) for r in scored} == {(n, s, day) for n in names for s in ("blind", "live") for day in days}
    means = registry.QUERIES["backtest_scores_grouping_sets"](spark, "").filter("bucket = 'all'").collect()
    assert len(means) == 32 and {r.n for r in means} == {57}


def network_of(spark, feeders, onward):
    """Feeders ``(number, route)`` from O at 12:00, of which number 99 calls at T an hour late; trains ``(number, minute)`` from T to D."""
    at = lambda minute: datetime.combine(TODAY, time()) + timedelta(minutes=minute)
    stop = lambda eva, number, arr, dep, late, path: (f"{eva}-{number}", eva, "S", number, None, arr and at(arr), None, False, dep and at(dep), dep and at(dep + late), False, path)
    live = [stop("1", n, None, 720, 0, route) for n, route in feeders] + [stop("3", "99", 730, None, 0, [])]
    live += [stop("3", n, None, m, 0, ["Dorf"]) for n, m in onward]
    columns = "stop_id string, eva string, category string, number string, line string, arr_planned timestamp_ntz, arr_changed timestamp_ntz, arr_cancelled boolean, dep_planned timestamp_ntz, dep_changed timestamp_ntz, dep_cancelled boolean, dep_path array<string>"
    runs = runs_of(spark, [(ago, 730, 60, 60, None, False) for ago in range(1, 31)], "S_99", "Tal", "3")
    for n, m in onward:
        for place, eva, tod in (("Tal", "3", m), ("Dorf", "4", m + 20)):
            runs = runs.unionByName(runs_of(spark, [(ago, tod, 0, 0, None, False) for ago in range(1, 11)], f"S_{n}", place, eva))
    stations = spark.createDataFrame([("1", "Ort", 500), ("2", "Ufer", 400), ("5", "Vils", 300), ("3", "Tal", 200), ("4", "Dorf", 100)], schemas.STATION)
    entries = spark.createDataFrame([], schemas.BOARD_ENTRY)
    return connections.Network(materialize(runs), entries, stations, spark.createDataFrame(live, columns))


def test_every_feeder_and_station_is_an_option(spark):
    feeders = [(str(n), ["Ufer"]) for n in range(60, 76)] + [("99", ["Ufer", "Vils", "Tal"])]
    network = network_of(spark, feeders, [("8", 800)])
    query = spark.createDataFrame(
        [("q", "Ort", "Dorf", datetime.combine(TODAY, time(12)), False, 5, TODAY)],
        "query_id string, from_text string, to_text string, depart timestamp_ntz, ticket_only boolean, transfer_minutes int, as_of date",
    )
    made = journeys.plan_journeys(query, network)
    assert [(r.stop_id, r.transfer_station) for r in made.itineraries.collect()] == [("1-99", "Tal")]
    assert [(r.status, r.found) for r in made.outcome.collect()] == [("OK", 1)]


def test_every_later_train_is_a_candidate(spark):
    onward = [(str(n), 731 + n) for n in range(8)] + [("8", 800)]
    network = network_of(spark, [], onward)
    request = spark.createDataFrame(
        [("q", "S", "99", None, "Tal", "Dorf", 5, False, datetime.combine(TODAY, time(12)), TODAY)],
        "query_id string, category string, number string, line string, transfer string, destination string, transfer_minutes int, ticket_only boolean, start timestamp_ntz, as_of date",
    )
    made = connections.plan_connections(request, network)
    caught = {r.cand_id: r.board_probability for r in made.transfers.candidates.collect()}
    assert len(caught) == 9 and caught["3-8"] == pytest.approx(1.0)
    assert made.outcome.collect()[0].status == "OK"


def test_boards_keep_every_stop(spark, monkeypatch):
    rows = [("1", "X", "S", str(n), None, None, 480 + n, 127, TODAY) for n in range(45)]
    entries = spark.createDataFrame(rows, schemas.BOARD_ENTRY)
    request = spark.createDataFrame([("b", "1", NOON - timedelta(hours=4), 5, TODAY)], "board_id string, eva string, start timestamp_ntz, hours int, as_of date")
    assert boards.synthetic_board(entries, request, runs_of(spark, [(1, 480, 0, None, None, False)])).count() == 45
    monkeypatch.setattr(registry.S, "network_events", lambda spark, d: None)
    monkeypatch.setattr(boards, "board_entries", lambda events: entries)
    monkeypatch.setattr(registry, "_board_requests", lambda spark, d: request)
    assert sorted(r.position for r in registry.QUERIES["synthetic_board"](spark, "").collect()) == list(range(1, 46))
    assert boards.first_stops(boards.plan_board(entries, request), 40).count() == 40
