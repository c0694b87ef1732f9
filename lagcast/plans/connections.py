"""Connections: feeder train, transfer station, any train toward the destination."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays, text, times
from lagcast.operators.boards import synthetic_board
from lagcast.operators.forecast import Forecasts, equal_mass_samples, forecast
from lagcast.operators.history import planned_calls, station_index
from lagcast.operators.stations import resolve_column
from lagcast.operators.transfer import Candidates, Transfers, build_candidates, headline_catch, propagate_transfer
from lagcast.session import materialize

BOARD = [
    "board_id",
    "stop_id",
    "eva",
    "category",
    "number",
    "line",
    "arr_planned",
    "arr_changed",
    "arr_cancelled",
    "dep_planned",
    "dep_changed",
    "dep_cancelled",
    "dep_path",
]


@dataclass(frozen=True)
class Network:
    """What a planner reads: histories, typical timetable, stations, live stops."""

    runs: DataFrame
    entries: DataFrame
    stations: DataFrame
    live: DataFrame | None = None
    stats: DataFrame | None = None
    calls: DataFrame = field(init=False)
    index: DataFrame = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "calls", materialize(planned_calls(self.runs)))
        object.__setattr__(self, "index", materialize(station_index(self.runs)))

    def boards(self, requests: DataFrame) -> DataFrame:
        """Stops of each requested ``(eva, start, hours, as_of)``; live plan first.

        A request without any live row falls back to the typical timetable.
        """
        wanted = requests.select("eva", "start", "hours", "as_of").distinct().withColumn(
            "board_id", board_id(F.col("eva"), F.col("start"), F.col("hours"), F.col("as_of"))
        )
        if self.live is None:
            return self._typical(wanted)
        sliced = F.col("slice").between(
            hour_of(F.col("start")), hour_of(F.col("start")) + F.make_dt_interval(hours=F.col("hours") - 1)
        )
        wanted = materialize(wanted)
        live = materialize(
            self.live.withColumn("slice", hour_of(F.coalesce("dep_planned", "arr_planned")))
            .join(wanted, "eva")
            .filter(sliced)
            .select(*BOARD)
        )
        rest = wanted.join(live.select("board_id").distinct(), "board_id", "left_anti")
        return live.withColumn("typical", F.lit(False)).unionByName(self._typical(rest))

    def _typical(self, wanted: DataFrame) -> DataFrame:
        stops = synthetic_board(self.entries, wanted, self.runs, self.calls)
        missing = F.lit(None).cast("timestamp_ntz")
        return stops.withColumns(
            {
                "arr_changed": missing,
                "dep_changed": missing,
                "arr_cancelled": F.lit(False),
                "dep_cancelled": F.lit(False),
                "typical": F.lit(True),
            }
        ).select(*BOARD, "typical")


def hour_of(ts):
    return times.at_minute(F.to_date(ts), F.hour(ts) * 60)


def board_id(eva, start, hours, as_of):
    return F.concat_ws("|", eva, start.cast("string"), hours.cast("string"), as_of.cast("string"))


@dataclass(frozen=True)
class Connections:
    outcome: DataFrame
    transfers: Transfers
    feeder: Forecasts


def shared_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct requests under a ``query_id`` of their own, and ``(asker, query_id)``.

    Requests that agree in all but their name are one: whoever asks for the same feeder, transfer,
    destination, ticket, minutes and start shares its plan.  Both tables are stored.
    """
    asked = [c for c in requests.columns if c != "query_id"]
    # Named by content, so a lost task that is run again gives the same names.
    name = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string") for c in asked])), 256)
    named = materialize(requests.withColumnRenamed("query_id", "asker").withColumn("query_id", name))
    return materialize(named.select("query_id", *asked).dropDuplicates(["query_id"])), named.select("asker", "query_id")


def for_askers(rows: DataFrame, askers: DataFrame) -> DataFrame:
    """Rows of shared requests, for each of their askers."""
    return rows.join(askers, "query_id").drop("query_id").withColumnRenamed("asker", "query_id").select(*rows.columns)


def plan_connections(requests: DataFrame, network: Network, max_candidates: int | None = None) -> Connections:
    """Outcome of every connection request; equal requests are planned once.

    Columns and meaning as in ``plan_requests``.
    """
    shared, askers = shared_requests(requests)
    made = plan_requests(shared, network, max_candidates)
    return Connections(
        for_askers(made.outcome, askers),
        Transfers(*(for_askers(t, askers) for t in (made.transfers.summary, made.transfers.candidates, made.transfers.points))),
        Forecasts(for_askers(made.feeder.summary, askers), for_askers(made.feeder.points, askers)),
    )


def plan_requests(requests: DataFrame, network: Network, max_candidates: int | None = None) -> Connections:
    """Outcome of distinct connection requests.

    ``requests``: ``query_id, category, number, line, transfer, destination,
    transfer_minutes, ticket_only, start, as_of``.  An unset ticket flag is on
    exactly when the ticket covers the feeder.  All departures of the board window
    count unless the caller sets ``max_candidates``.
    """
    placed = resolve_column(requests, "transfer", network.stations, "transfer")
    placed = resolve_column(placed, "destination", network.stations, "dest").withColumns(
        {
            "dest_name": F.coalesce("dest_name", F.trim("destination")),
            "ticket_only": F.coalesce("ticket_only", delays.ticket_covers(F.col("category"))),
            "hours": F.lit(P.TRANSFER_BOARD_HOURS),
            "board_id": board_id(F.col("transfer_eva"), F.col("start"), F.lit(P.TRANSFER_BOARD_HOURS), F.col("as_of")),
        }
    )
    placed = materialize(placed)
    boards = network.boards(
        placed.filter("transfer_eva is not null").select(F.col("transfer_eva").alias("eva"), "start", "hours", "as_of")
    )
    asked = placed.select(
        "query_id",
        "board_id",
        F.col("category").alias("f_category"),
        F.col("number").alias("f_number"),
        F.col("line").alias("f_line"),
        "transfer_eva",
        "transfer_name",
        "dest_name",
        "transfer_minutes",
        "ticket_only",
        "as_of",
    )
    seen = materialize(boards.drop("eva").join(asked, "board_id"))
    own = (F.col("category") == F.col("f_category")) & (F.col("number") == F.col("f_number"))
    position = F.struct(F.coalesce("dep_planned", "arr_planned"), "stop_id")
    feeder_stop = materialize(
        seen.filter(own)
        .groupBy("query_id")
        .agg(
            F.min_by(
                F.struct("arr_planned", times.live_minutes(F.col("arr_changed"), F.col("arr_planned")).alias("live")),
                position,
            ).alias("f")
        )
        .select("query_id", F.col("f.arr_planned").alias("feeder_planned"), F.col("f.live").alias("feeder_live"))
        .filter("feeder_planned is not null")
    )
    arriving = asked.join(feeder_stop, "query_id")
    made = forecast(
        arriving.select(
            "query_id",
            F.col("f_category").alias("category"),
            F.col("f_number").alias("number"),
            F.col("f_line").alias("line"),
            F.col("transfer_eva").alias("eva"),
            F.col("transfer_name").alias("place"),
            F.col("feeder_planned").alias("planned"),
            F.col("feeder_live").alias("live"),
            "as_of",
        ),
        network.runs,
        network.stats,
        network.index,
    )
    departures = (
        seen.join(feeder_stop, "query_id")
        .filter(F.col("dep_planned").isNotNull() & ~own)
        .filter(text.route_reaches(F.col("dep_path"), F.col("dest_name"), both_ways=False))
        .filter(~F.col("ticket_only") | delays.ticket_covers(F.col("category")))
        .filter(
            F.col("dep_planned")
            >= F.col("feeder_planned") - F.make_dt_interval(mins=F.lit(P.LOOKBACK_BEFORE_FEEDER_MIN))
        )
    )
    if max_candidates is not None:
        by_departure = Window.partitionBy("query_id").orderBy("dep_planned", "stop_id")
        departures = departures.withColumn("rank", F.row_number().over(by_departure)).filter(F.col("rank") <= max_candidates)
    nearest = materialize(
        departures.select(
            "query_id",
            F.col("stop_id").alias("cand_id"),
            "category",
            "number",
            "line",
            "dep_planned",
            times.live_minutes(F.col("dep_changed"), F.col("dep_planned")).alias("dep_live"),
            "dep_cancelled",
            "transfer_eva",
            "transfer_name",
            F.col("dest_name").alias("destination"),
            "as_of",
        )
    )
    candidates: Candidates = build_candidates(nearest, network.runs, network.index)
    transfers = propagate_transfer(
        arriving.select("query_id", "feeder_planned", "transfer_minutes"), equal_mass_samples(made), candidates
    )
    chosen = transfers.summary.join(headline_catch(transfers.candidates), "query_id", "left")
    counted = nearest.groupBy("query_id").agg(F.count("*").alias("listed"))
    outcome = (
        placed.select("query_id", "transfer_eva", "transfer_name", "dest_name")
        .join(feeder_stop, "query_id", "left")
        .join(counted, "query_id", "left")
        .join(chosen, "query_id", "left")
        .withColumn("status", connection_status())
    )
    return Connections(outcome, transfers, made)


def connection_status():
    return (
        F.when(F.col("transfer_eva").isNull(), "TRANSFER_NOT_FOUND")
        .when(F.col("feeder_planned").isNull(), "FEEDER_NOT_REACHING")
        .when(F.col("listed").isNull(), "NO_CANDIDATES")
        .when(F.col("reference_arrival").isNull(), "NOT_ENOUGH_HISTORY")
        .otherwise("OK")
    )
