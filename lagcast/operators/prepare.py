"""Stop events to prepared events with the delay at the previous stop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays, text, times
from lagcast.operators.sequence import previous_value


def identified(stop_event: DataFrame) -> DataFrame:
    """Normalised station number and train identity."""
    return stop_event.withColumns(
        {
            "eva": text.station_id(F.col("eva")),
            "identity": text.train_identity(F.col("train_type"), F.col("train_number")),
        }
    )


def trains_calling_at(identified_events: DataFrame, stations: DataFrame | list[str] | None) -> DataFrame:
    """All stops of the trains that call at a wanted station.

    Runs before any sort.  No broadcast hint: the adaptive planner broadcasts
    the distinct identities when they turn out small and splits hot join keys
    when they do not.
    """
    if stations is None:
        return identified_events
    if isinstance(stations, DataFrame):
        there = identified_events.join(stations.select(text.station_id(F.col("eva")).alias("eva")), "eva", "left_semi")
    else:
        there = identified_events.filter(F.col("eva").isin([s.lstrip("0") for s in stations]))
    return identified_events.join(there.select("identity").distinct(), "identity", "left_semi")


def with_delays(events: DataFrame, departure_first: bool = False) -> DataFrame:
    """Whole-minute delays and the planned time."""
    sides = ["departure_planned_time", "arrival_planned_time"]
    return events.withColumns(
        {
            "arr_delay": times.whole_minutes(F.col("arrival_change_time"), F.col("arrival_planned_time")),
            "dep_delay": times.whole_minutes(F.col("departure_change_time"), F.col("departure_planned_time")),
            "planned": F.coalesce(*(sides if departure_first else sides[::-1])),
        }
    )


def complete(events: DataFrame, need_train: bool = True) -> DataFrame:
    """Rows with a planned time and, unless told otherwise, a train type and number."""
    keep = F.col("planned").isNotNull()
    if need_train:
        keep = keep & F.col("train_type").isNotNull() & F.col("train_number").isNotNull()
    return events.filter(keep)


def with_previous_delay(events: DataFrame, tie: str | None = None) -> DataFrame:
    """Delay at the previous stop of the same ride and service day.

    ``tie`` names a unique number that orders rows of one stop position; without
    it the planned and changed times do.
    """
    number = F.col("train_line_station_num")
    prepared = events.withColumns(
        {
            "service_day": times.service_day(F.col("planned")),
            "_ride": F.coalesce(F.concat(F.lit("="), "train_line_ride_id"), F.lit("")),
            "_stop": F.coalesce(number, F.lit(-(2**62))),
            "_part": F.floor(F.col(tie) / P.CHUNK_SPAN) if tie else F.col("planned"),
        }
    )
    order = [tie] if tie else ["arrival_change_time", "departure_change_time", "eva", "train_type", "train_number"]
    delay = F.coalesce("arr_delay", "dep_delay")
    out = previous_value(prepared, ["_ride", "service_day"], ["_stop", "_part"], order, delay, "prev_delay")
    return out.drop("_ride", "_stop", "_part")


def prepare_events(
    stop_event: DataFrame,
    stations: DataFrame | list[str] | None = None,
    tie: str | None = None,
    need_train: bool = True,
) -> DataFrame:
    """Prepared events.  The lag sees every stop of a kept train, so a station
    filter belongs after this step."""
    events = complete(with_delays(trains_calling_at(identified(stop_event), stations)), need_train)
    return with_previous_delay(events, tie).withColumns(
        {"day": F.to_date("planned"), "tod": times.minute_of_day(F.col("planned"))}
    )


def usable() -> Column:
    """Runs that were not cancelled and whose final delay is known."""
    return ~F.col("cancelled") & delays.final_delay(F.col("arr_delay"), F.col("dep_delay")).isNotNull()
