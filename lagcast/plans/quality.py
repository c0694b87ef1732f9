"""Data-quality check of planned times against the histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast import params as P


def timetable_check(plan: DataFrame, calls: DataFrame) -> DataFrame:
    """Nearest planned time in the history for each ``(train_key, station_name, tod)``.

    ``calls`` are the distinct planned times, so a stop meets at most the
    minutes of one day.
    """
    known = calls.select("train_key", F.lower("station_name").alias("place"), F.col("tod").alias("known_tod")).distinct()
    asked = plan.select("train_key", "station_name", F.lower("station_name").alias("place"), "tod").distinct()
    nearest = (
        asked.join(known, ["train_key", "place"])
        .groupBy("train_key", "station_name", "tod")
        .agg(F.min(F.struct(F.abs(F.col("known_tod") - F.col("tod")).alias("gap"), "known_tod")).alias("m"))
    )
    return nearest.select(
        "train_key",
        "station_name",
        "tod",
        F.col("m.known_tod").alias("nearest_tod"),
        F.col("m.gap").alias("gap"),
        (F.col("m.gap") > P.CHECK_TOLERANCE).alias("mismatch"),
    )
