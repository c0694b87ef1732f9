"""Rebuilding only what changed: versions of daily partitions, and a history store that follows them.

Stop events lie in one folder per service day.  The previous stop of a ride is of the same service day,
so a day's runs need no other day's events, and a changed day is recomputed alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.functions import times
from lagcast.operators.history import history_runs
from lagcast.operators.prepare import prepare_events
from lagcast.session import file_system, generations
from lagcast.sources.tables import write_daily
from lagcast.sources.tiers import stale_partitions

VERSION = "service_day string, version long"


def event_service_day():
    return times.service_day(F.coalesce("arrival_planned_time", "departure_planned_time"))


def partition_versions(spark: SparkSession, path: str) -> DataFrame:
    """``service_day, version`` of each partition folder, from names, sizes and times of its files; no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    day = F.nullif(F.regexp_extract("path", r"/service_day=([^/]+)/", 1), F.lit(""))
    marks = files.select(day.alias("service_day"), F.xxhash64("path", "length", "modificationTime").alias("mark"))
    return marks.filter("service_day rlike '^[0-9-]+$'").groupBy("service_day").agg(
        F.xxhash64(F.array_sort(F.collect_list("mark"))).alias("version")
    )


def processed_versions(spark: SparkSession, store: str) -> DataFrame:
    """What the newest committed manifest says was built."""
    found = generations(spark, f"{store}/manifest")
    if not found:
        return spark.createDataFrame([], VERSION)
    return spark.read.schema(VERSION).parquet(f"{store}/manifest/generation={found[-1]}")


def rebuild_runs(spark: SparkSession, events: str, store: str, tie: str | None = None) -> list[str]:
    """Bring the run store up to the daily events; the service days that were recomputed or dropped.

    Only partitions whose version differs from the manifest are read.  Their days are swapped in by a dynamic
    partition overwrite, and the manifest is committed last: a rebuild that dies is simply done again.
    """
    available, done = partition_versions(spark, events), processed_versions(spark, store)
    # Calendar days, whatever the number of events.
    stale = sorted(r.service_day for r in stale_partitions(available, done, ["service_day", "version"]).collect())
    gone = sorted(r.service_day for r in done.join(available, "service_day", "left_anti").collect())
    if not stale and not gone:
        return []
    fs, path = file_system(spark, store)
    if stale:
        changed = spark.read.parquet(events).filter(F.col("service_day").cast("string").isin(stale))
        runs = history_runs(prepare_events(changed, tie=tie))
        write_daily(runs, f"{store}/runs", times.service_day(times.at_minute(F.col("day"), F.col("tod"))))
    for day in [*stale, *gone]:
        folder = path(f"{store}/runs/service_day={day}")
        # A day that no longer has runs leaves none behind.
        if day in gone and fs.exists(folder):
            fs.delete(folder, True)
    numbers = generations(spark, f"{store}/manifest")
    temporary = f"{store}/manifest/_writing-{uuid.uuid4().hex}"
    available.write.parquet(temporary)
    if not fs.rename(path(temporary), path(f"{store}/manifest/generation={(numbers[-1] if numbers else 0) + 1}")):
        raise OSError("cannot commit the manifest")
    return sorted({*stale, *gone})


def stored_runs(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/runs").drop("service_day")
