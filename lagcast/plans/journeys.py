"""Journeys: direct trains and one-transfer connections, ranked by median arrival."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays, text, times
from lagcast.functions.calendar import next_timetable_change
from lagcast.operators import distribution as D
from lagcast.operators.boards import with_train_key
from lagcast.operators.forecast import forecast, forecast_cards
from lagcast.operators.stations import resolve_column, stations_by_name
from lagcast.operators.transfer import match_destination
from lagcast.plans.connections import Connections, Network, board_id, for_askers, plan_requests, shared_requests
from lagcast.session import materialize


@dataclass(frozen=True)
class Budgets:
    """What a planner may spend on a query; without a limit unless the caller sets one.

    With any of the last three set, transfers are chosen by ``choose_transfers``;
    else every option counts.
    """

    direct: int | None = None
    feeders: int | None = None
    attempts: int | None = None
    results: int | None = None
    per_feeder: int | None = None


@dataclass(frozen=True)
class Journeys:
    """``itineraries`` is ranked per query; ``outcome`` has one status row per query."""

    outcome: DataFrame
    itineraries: DataFrame


def place_queries(queries: DataFrame, stations: DataFrame) -> DataFrame:
    """Resolve both ends of ``(query_id, from_text, to_text, depart, ticket_only,
    transfer_minutes, as_of)``; the ticket filter is on unless switched off."""
    placed = resolve_column(queries, "from_text", stations, "from")
    placed = resolve_column(placed, "to_text", stations, "to")
    return placed.withColumns(
        {
            "ticket_only": F.coalesce("ticket_only", F.lit(True)),
            "transfer_minutes": F.coalesce("transfer_minutes", F.lit(P.DEFAULT_TRANSFER_MIN)),
            "board_id": board_id(F.col("from_eva"), F.col("depart"), F.lit(P.JOURNEY_BOARD_HOURS), F.col("as_of")),
            "same": F.col("from_eva") == F.col("to_eva"),
        }
    )


def usable_departures(placed: DataFrame, boards: DataFrame) -> DataFrame:
    """Departures of each query: planned, running, in time, allowed by the ticket."""
    return (
        boards.drop("eva")
        .join(placed.filter("not same"), "board_id")
        .filter(F.col("dep_planned").isNotNull() & ~F.col("dep_cancelled"))
        .filter(F.col("dep_planned") >= F.col("depart"))
        .filter(~F.col("ticket_only") | delays.ticket_covers(F.col("category")))
        .withColumns(
            {
                "direct": text.route_reaches(F.col("dep_path"), F.col("to_name"), both_ways=True),
                "feeder_id": F.concat_ws("|", "query_id", "stop_id"),
                "dep_live": times.live_minutes(F.col("dep_changed"), F.col("dep_planned")),
            }
        )
    )


def first_departures(departures: DataFrame, limit: int | None) -> DataFrame:
    by_time = Window.partitionBy("query_id").orderBy("dep_planned", "stop_id")
    ranked = departures.withColumn("rank", F.row_number().over(by_time))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def direct_itineraries(departures: DataFrame, network: Network, limit: int | None = None) -> DataFrame:
    """The first direct trains of each query (all without a limit) with their predicted arrival."""
    direct = first_departures(departures.filter("direct"), limit)
    keyed = with_train_key(direct, network.index)
    ended = match_destination(keyed, network.index, "to_name", "dest_station", "to_eva", True)
    # The newest day's first planned time gives the planned arrival.
    newest = network.calls.groupBy("train_key", F.col("station_name").alias("dest_station")).agg(
        F.max_by("tod", F.struct("last_day", (-F.col("tod")).alias("t"))).alias("arr_tod")
    )
    arriving = materialize(
        ended.join(newest, ["train_key", "dest_station"]).withColumn(
            "reference_arrival", times.next_at(F.col("dep_planned"), F.col("arr_tod"))
        )
    )
    made = forecast(
        arriving.select(
            F.col("feeder_id").alias("query_id"),
            "category",
            "number",
            "line",
            F.col("to_eva").alias("eva"),
            F.col("to_name").alias("place"),
            F.col("reference_arrival").alias("planned"),
            F.col("dep_live").alias("live"),
            "as_of",
        ),
        network.runs,
        network.stats,
        network.index,
    )
    cards = forecast_cards(made).select(F.col("query_id").alias("feeder_id"), "median", "q10", "q90", "source")
    return arriving.join(cards, "feeder_id").select(
        "query_id",
        "stop_id",
        "dep_planned",
        F.lit(None).cast("string").alias("transfer_station"),
        "reference_arrival",
        "median",
        "q10",
        "q90",
        F.lit(None).cast("double").alias("catch_probability"),
        F.lit(None).cast("double").alias("miss_probability"),
    )


def transfer_options(departures: DataFrame, stations: DataFrame, max_feeders: int | None = None) -> DataFrame:
    """Stations where a feeder can be left, heaviest first; a station that its route names several times is one."""
    feeders = first_departures(departures.filter("not direct"), max_feeders)
    stops = feeders.select(
        *feeders.columns, F.posexplode("dep_path").alias("at", "stop_name")
    ).withColumn("norm", text.normal_name(F.col("stop_name")))
    named = stations_by_name(stations).select(
        "norm", F.col("eva").alias("t_eva"), F.col("name").alias("t_name"), F.col("weight").alias("t_weight")
    )
    fitting = stops.join(named, "norm").filter(
        (F.col("t_eva") != F.col("to_eva")) & (F.col("t_weight") >= P.MIN_TRANSFER_WEIGHT)
    )
    same = Window.partitionBy("feeder_id", "t_eva").orderBy("at")
    once = fitting.withColumn("nth", F.row_number().over(same)).filter("nth = 1").drop("nth")
    heaviest = Window.partitionBy("feeder_id").orderBy(F.desc("t_weight"), "at")
    return once.withColumn("pick", F.row_number().over(heaviest))


def choose_transfers(
    tried: DataFrame,
    attempts: int | None = None,
    results: int | None = None,
    per_feeder: int | None = None,
) -> DataFrame:
    """Walk through each query's feeders and picks as a traveller with budgets would.

    ``tried``: ``query_id, rank, pick, name, works``.  The stations of a query's feeders
    are folded by one array aggregate, because every step depends on the
    stations tried, the attempts left and the results found before it.
    """
    steps = tried.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "pick", "name", "works"))).alias("steps")
    )
    start = F.struct(
        F.array().cast("array<string>").alias("seen"),
        F.lit(attempts or 0).alias("left"),
        F.lit(0).alias("found"),
        F.lit(0).alias("feeder"),
        F.lit(0).alias("picks"),
        F.lit(False).alias("done"),
        F.array().cast("array<struct<rank:int,pick:int>>").alias("chosen"),
    )

    def walk(state, step):
        fresh = step["rank"] != state["feeder"]
        picks = F.when(fresh, 0).otherwise(state["picks"])
        done = ~fresh & state["done"]
        attempt = (
            (F.lit(attempts is None) | (state["left"] > 0))
            & (F.lit(True) if results is None else state["found"] < results)
            & ~done
            & (F.lit(True) if per_feeder is None else picks < per_feeder)
            & ~F.array_contains(state["seen"], step["name"])
        )
        success = attempt & step["works"]
        one = attempt.cast("int")
        return F.struct(
            F.when(attempt, F.array_append(state["seen"], step["name"])).otherwise(state["seen"]).alias("seen"),
            (state["left"] - one).alias("left"),
            (state["found"] + success.cast("int")).alias("found"),
            step["rank"].alias("feeder"),
            (picks + one).alias("picks"),
            (done | success).alias("done"),
            F.when(success, F.array_append(state["chosen"], F.struct(step["rank"].alias("rank"), step["pick"].alias("pick"))))
            .otherwise(state["chosen"])
            .alias("chosen"),
        )

    chosen = F.aggregate("steps", start, walk, lambda state: state["chosen"])
    return steps.select("query_id", F.inline(chosen))


def transfer_itineraries(departures: DataFrame, network: Network, budgets: Budgets = Budgets()) -> DataFrame:
    """One itinerary for every feeder and transfer station of each query that work."""
    options = materialize(
        transfer_options(departures, network.stations, budgets.feeders).withColumn(
            "option_id", F.concat_ws("|", "feeder_id", F.col("pick").cast("string"))
        )
    )
    requests = options.select(
        F.col("option_id").alias("query_id"),
        "category",
        "number",
        "line",
        F.col("t_name").alias("transfer"),
        F.col("to_name").alias("destination"),
        "transfer_minutes",
        "ticket_only",
        F.col("dep_planned").alias("start"),
        "as_of",
    )
    # Journeys of many travellers lead over the same feeders: each distinct option is planned and summed up once.
    shared, askers = shared_requests(requests)
    planned: Connections = plan_requests(shared, network)
    shape = D.card(planned.transfers.points, ["query_id"])
    worked = materialize(
        for_askers(planned.outcome.join(shape, "query_id", "left"), askers).select(
            F.col("query_id").alias("option_id"),
            F.col("transfer_name").alias("transfer_station"),
            (F.col("status") == "OK").alias("works"),
            "reference_arrival",
            "median",
            "q10",
            "q90",
            "catch_probability",
            "miss_probability",
        )
    )
    joined = options.join(worked, "option_id")
    walk = (budgets.attempts, budgets.results, budgets.per_feeder)
    if walk == (None, None, None):
        made = joined.filter("works")
    else:
        tried = joined.select("query_id", "rank", "pick", F.col("t_name").alias("name"), "works")
        made = joined.join(choose_transfers(tried, *walk), ["query_id", "rank", "pick"])
    return made.select(
        "query_id",
        "stop_id",
        "dep_planned",
        "transfer_station",
        "reference_arrival",
        "median",
        "q10",
        "q90",
        "catch_probability",
        "miss_probability",
    )


def rank_itineraries(itineraries: DataFrame) -> DataFrame:
    """The five itineraries with the earliest median arrival."""
    arrival = times.plus_minutes(F.col("reference_arrival"), F.col("median"))
    best = Window.partitionBy("query_id").orderBy("median_arrival", "dep_planned", "stop_id", "transfer_station")
    return (
        itineraries.withColumn("median_arrival", arrival)
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= P.MAX_ITINERARIES)
        .withColumn("travel_minutes", times.trip_minutes(F.col("dep_planned"), F.col("median_arrival")))
    )


def plan_journeys(queries: DataFrame, network: Network, budgets: Budgets = Budgets()) -> Journeys:
    placed = materialize(place_queries(queries, network.stations))
    boards = network.boards(
        placed.filter("from_eva is not null and to_eva is not null and not same").select(
            F.col("from_eva").alias("eva"), F.col("depart").alias("start"), F.lit(P.JOURNEY_BOARD_HOURS).alias("hours"), "as_of"
        )
    )
    departures = materialize(usable_departures(placed, boards))
    ranked = materialize(
        rank_itineraries(
            direct_itineraries(departures, network, budgets.direct).unionByName(
                transfer_itineraries(departures, network, budgets)
            )
        )
    )
    seen = departures.groupBy("query_id").agg(F.count("*").alias("departures"), F.max("typical").alias("typical"))
    found = ranked.groupBy("query_id").agg(F.count("*").alias("found"), F.min("dep_planned").alias("first_departure"))
    crosses = F.to_date("first_departure") >= next_timetable_change(F.col("as_of"))
    outcome = (
        placed.join(seen, "query_id", "left")
        .join(found, "query_id", "left")
        .select(
            "query_id",
            "from_name",
            "to_name",
            F.coalesce("typical", F.lit(False)).alias("typical"),
            F.coalesce("found", F.lit(0)).alias("found"),
            F.coalesce(F.col("typical") & crosses, F.lit(False)).alias("crosses_change"),
            F.when(F.col("from_name").isNull(), "ORIGIN_NOT_FOUND")
            .when(F.col("to_name").isNull(), "DESTINATION_NOT_FOUND")
            .when(F.col("same"), "SAME_STATION")
            .when(F.col("departures").isNull(), "NO_TIMETABLE")
            .when(F.col("found").isNull(), "NO_PLANNABLE_TRAIN")
            .otherwise("OK")
            .alias("status"),
        )
    )
    return Journeys(outcome, ranked)
