"""Readers and writers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast import schemas


def read_stop_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Monthly and daily stop-event files as one table (an empty glob raises)."""
    return spark.read.schema(schemas.STOP_EVENT).parquet(*paths)


def with_source_file(df: DataFrame) -> DataFrame:
    """Tag rows with the stem of their file, or of the folder of its parts, and the tier it belongs to."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.parquet(?:/part-[^/]+)?$", 1)
    tagged = df.withColumn("source_file", stem)
    month = F.regexp_extract("source_file", r"^data-(\d{4}-\d{2})$", 1)
    recent = F.regexp_extract("source_file", r"^data-recent-(\d{4}-\d{2}-\d{2})$", 1)
    return tagged.withColumns(
        {
            "month": F.nullif(month, F.lit("")),
            "recent_day": F.nullif(recent, F.lit("")),
        }
    )


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """``eva;name;weight`` lines; short lines go, a bad weight is 0."""
    parts = F.split(F.col("value"), ";")
    return (
        spark.read.text(path)
        .filter(F.size(parts) >= 3)
        .select(
            parts[0].alias("eva"),
            parts[1].alias("name"),
            F.coalesce(parts[2].try_cast("int"), F.lit(0)).alias("weight"),
        )
    )


def write_daily(stop_event: DataFrame, path: str, day: Column) -> None:
    """Condensed daily table, one folder per service day; a rerun replaces its days.

    ``rebalance`` lets the adaptive planner split a large day over several files.
    """
    (
        stop_event.withColumn("service_day", day)
        .hint("rebalance", "service_day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("service_day")
        .parquet(path)
    )


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").json(path)
