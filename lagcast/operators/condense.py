"""Folding plan and change documents into stop events and live boards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.functions.text import station_id
from lagcast.sources.raw_log import change_stops, plan_stops


def first_plan(plan: DataFrame) -> DataFrame:
    """The first labelled plan row of each stop, in (file, time, position) order."""
    fields = [c for c in plan.columns if c not in ("stop_id", "ord")]
    return (
        plan.filter("labelled")
        .groupBy("stop_id")
        .agg(F.min_by(F.struct(*fields), "ord").alias("p"))
        .select("stop_id", "p.*")
    )


#: What stop events take from a plan row besides its id.
PLAN_FIELDS = ["station", "eva", "category", "number", "arr_line", "dep_line", "arr_planned", "dep_planned"]
CHANGE_FIELDS = ["arr_changed", "arr_status", "dep_changed", "dep_status"]


def fold_changes(changes: DataFrame) -> DataFrame:
    """Last known value per attribute and stop: an unset attribute keeps the older value."""

    def last(name: str):
        known = F.when(F.col(name).isNotNull(), F.struct("ord", name))
        return F.max(known)[name].alias(name)

    return changes.groupBy("stop_id").agg(*[last(name) for name in CHANGE_FIELDS])


def condense(plan: DataFrame, folded: DataFrame, stations: DataFrame | list[str] | None = None) -> DataFrame:
    """Planned stops with their folded changes as stop events.

    A stop without a change runs as planned.  With ``stations``, whole runs that
    call at one of them are kept.
    """
    stops = with_run(plan)
    if stations is not None:
        if isinstance(stations, DataFrame):
            there = stops.join(stations.select(station_id(F.col("eva")).alias("eva")), "eva", "left_semi")
        else:
            there = stops.filter(F.col("eva").isin(list(stations)))
        stops = stops.join(there.select("run_id").distinct(), "run_id", "left_semi")
    return as_events(stops.join(folded, "stop_id", "left"))


def with_run(plan: DataFrame) -> DataFrame:
    run_id = F.regexp_extract("stop_id", r"^(.*)-([^-]*)$", 1)
    number = F.regexp_extract("stop_id", r"^(.*)-([^-]*)$", 2).try_cast("bigint")
    return plan.withColumns({"run_id": run_id, "stop_number": number})


def joined_events(joined: DataFrame) -> DataFrame:
    """Stop events of planned stops that carry their folded changes already."""
    return as_events(with_run(joined))


def as_events(stops: DataFrame) -> DataFrame:
    merged = stops.filter(F.col("stop_number").isNotNull())
    line = F.coalesce(F.nullif("arr_line", F.lit("")), F.nullif("dep_line", F.lit("")))
    cancelled = F.coalesce(F.col("arr_status") == "c", F.lit(False)) | F.coalesce(
        F.col("dep_status") == "c", F.lit(False)
    )
    return merged.select(
        F.col("station").alias("station_name"),
        "eva",
        F.col("category").alias("train_type"),
        F.col("number").alias("train_number"),
        line.alias("line_number"),
        F.col("run_id").alias("train_line_ride_id"),
        F.col("stop_number").alias("train_line_station_num"),
        F.col("arr_planned").alias("arrival_planned_time"),
        F.coalesce("arr_changed", "arr_planned").alias("arrival_change_time"),
        F.col("dep_planned").alias("departure_planned_time"),
        F.coalesce("dep_changed", "dep_planned").alias("departure_change_time"),
        cancelled.alias("is_canceled"),
    )


def condense_day(log: DataFrame, stations: DataFrame | list[str] | None = None) -> DataFrame:
    """Raw API log of a day (or of any number of days) to stop events."""
    return condense(first_plan(plan_stops(log)), fold_changes(change_stops(log)), stations)


def latest_change(changes: DataFrame) -> DataFrame:
    """The last change row of each stop as a whole, nulls included."""
    fields = [c for c in changes.columns if c not in ("stop_id", "ord", "eva")]
    return (
        changes.groupBy("stop_id")
        .agg(F.max_by(F.struct(*fields), "ord").alias("c"))
        .select("stop_id", "c.*")
    )


def live_board(plan: DataFrame, changes: DataFrame) -> DataFrame:
    """Planned stops, each id once, with the latest change applied.

    Unlike ``fold_changes`` a newer change replaces the older one even where it
    is null.
    """
    kept = [c for c in plan.columns if c not in ("stop_id", "ord", "labelled")]
    stops = plan.groupBy("stop_id").agg(F.min_by(F.struct(*kept), "ord").alias("p")).select("stop_id", "p.*")
    joined = stops.join(latest_change(changes), "stop_id", "left")

    def event(name: str) -> dict:
        there = F.col(f"{name}_present")
        return {
            f"{name}_changed": F.when(there, F.col(f"{name}_changed")),
            f"{name}_changed_platform": F.when(there, F.col(f"{name}_changed_platform")),
            f"{name}_cancelled": there & F.coalesce(F.col(f"{name}_status") == "c", F.lit(False)),
            f"{name}_best": F.when(there, F.coalesce(f"{name}_changed", f"{name}_planned")),
            f"{name}_best_platform": F.when(there, F.coalesce(f"{name}_changed_platform", f"{name}_platform")),
        }

    line = F.coalesce("arr_line", "dep_line")
    return (
        joined.withColumns({**event("arr"), **event("dep"), "line": line})
        .withColumns(
            {
                "origin": F.try_element_at("arr_path", F.lit(1)),
                "destination": F.try_element_at("dep_path", F.lit(-1)),
            }
        )
        .drop("arr_status", "dep_status", "arr_line", "dep_line")
    )


def current_rows(board: DataFrame, now, departures: bool = True) -> DataFrame:
    """Board rows that are not older than five minutes, by best time."""
    best = "dep_best" if departures else "arr_best"
    return board.filter(F.col(best) >= now - F.make_dt_interval(mins=F.lit(5))).orderBy(best, "stop_id")
