"""Per-train delay histories as a flat run table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.functions import delays, text


def history_runs(prepared: DataFrame) -> DataFrame:
    """One row per run of a train past a station, delays clamped; cancelled runs stay."""
    return prepared.select(
        text.train_key(F.col("identity")).alias("train_key"),
        F.col("identity").alias("train"),
        "train_type",
        "line_number",
        F.coalesce("station_name", F.lit("")).alias("station_name"),
        "eva",
        "day",
        "tod",
        *[delays.clamp(F.col(c)).alias(c) for c in ("arr_delay", "dep_delay", "prev_delay")],
        F.coalesce("is_canceled", F.lit(False)).alias("cancelled"),
    )


def train_lines(runs: DataFrame) -> DataFrame:
    """Name, type and last filled line of each train."""
    last = F.struct("day", "tod", "train", "line_number")
    return runs.groupBy("train_key").agg(
        F.max_by("train", last).alias("train"),
        F.max_by("train_type", last).alias("train_type"),
        F.max(F.when(F.length("line_number") > 0, last))["line_number"].alias("line"),
    )


def history_index(runs: DataFrame) -> DataFrame:
    """Runs held per train key."""
    return runs.groupBy("train_key").agg(F.count("*").alias("runs"))


def station_index(runs: DataFrame) -> DataFrame:
    """Stations of each train; a name keeps one station number."""
    return runs.groupBy("train_key", "station_name").agg(F.min("eva").alias("eva"))


def planned_calls(runs: DataFrame) -> DataFrame:
    """Distinct planned times of each train at each station."""
    return runs.groupBy("train_key", "station_name", "eva", "tod").agg(
        F.max("day").alias("last_day"), F.count("*").alias("runs")
    )


def build_metadata(runs: DataFrame, sources: DataFrame, stations: list[str] | None = None) -> DataFrame:
    """One row on a build: months, trains and the range of recent days.

    ``sources`` carries ``month`` and ``recent_day``, e.g. from ``with_source_file``.
    """
    months = sources.select("month", "recent_day").distinct()
    files = months.agg(
        F.array_sort(F.collect_set("month")).alias("months"),
        F.min("recent_day").alias("recent_from"),
        F.max("recent_day").alias("recent_through"),
    )
    trains = runs.select("train_key").distinct().agg(F.count("*").alias("trains"))
    return files.select(
        F.current_date().alias("generated"),
        F.array(*[F.lit(s) for s in stations or []]).cast("array<string>").alias("stations"),
        "months",
        trains.scalar().alias("trains"),
        "recent_from",
        "recent_through",
    )


OVERLAY_KEYS = ["train_key", "station_name", "day", "tod"]


def overlay_recent(base: DataFrame, recent: DataFrame) -> DataFrame:
    """Base runs plus recent ones; the recent tier wins on the same planned stop."""
    covered = recent.select(*OVERLAY_KEYS).distinct()
    return base.join(covered, OVERLAY_KEYS, "left_anti").unionByName(recent)
