"""Raw API log: plan and change documents to stop rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast import schemas
from lagcast.functions.text import split_route
from lagcast.functions.times import parse_compact

PLAN_API, CHANGE_API = "timetables/v1/plan", "timetables/v1/fchg"


def read_raw_log(spark: SparkSession, *paths: str) -> DataFrame:
    log = spark.read.schema(schemas.RAW_LOG).parquet(*paths)
    return log.withColumn("file", F.input_file_name())


def documents(log: DataFrame, api: str) -> DataFrame:
    """Documents of one API with a station number in their URL and any text."""
    eva = F.regexp_extract("url", r"/(?:plan|fchg)/0*(\d+)", 1)
    return (
        log.filter((F.col("api_name") == api) & (F.length("response_data") > 0))
        .withColumn("eva", eva)
        .filter(F.col("eva") != "")
        .select("file", "timestamp", "eva", "response_data")
    )


def _stops(log: DataFrame, api: str, schema: str) -> DataFrame:
    # A malformed document parses to nulls and yields no row; the ordering
    # triple (file, timestamp, position) replaces a global sort.
    parsed = documents(log, api).withColumn("doc", F.from_xml("response_data", schema))
    return (
        parsed.select(
            "file", "timestamp", "eva", F.col("doc._station").alias("station"), F.posexplode("doc.s").alias("pos", "s")
        )
        .filter(F.length("s._id") > 0)
    )


def plan_stops(log: DataFrame) -> DataFrame:
    stops = _stops(log, PLAN_API, schemas.PLAN_DOCUMENT)

    def event(tag: str, name: str) -> dict:
        node = F.col(f"s.{tag}")
        return {
            f"{name}_present": node.isNotNull(),
            f"{name}_planned": parse_compact(node["_pt"]),
            f"{name}_platform": node["_pp"],
            f"{name}_line": node["_l"],
            f"{name}_path": split_route(node["_ppth"]),
        }

    columns = {
        "stop_id": F.col("s._id"),
        "labelled": F.col("s.tl").isNotNull(),
        "category": F.coalesce("s.tl._c", F.lit("")),
        "number": F.coalesce("s.tl._n", F.lit("")),
        **event("ar", "arr"),
        **event("dp", "dep"),
    }
    return stops.select(
        F.struct("file", "timestamp", "pos").alias("ord"), "eva", "station", *[c.alias(n) for n, c in columns.items()]
    )


def change_stops(log: DataFrame) -> DataFrame:
    stops = _stops(log, CHANGE_API, schemas.CHANGE_DOCUMENT)

    def event(tag: str, name: str) -> dict:
        node = F.col(f"s.{tag}")
        return {
            f"{name}_changed": parse_compact(node["_ct"]),
            f"{name}_changed_platform": node["_cp"],
            f"{name}_status": node["_cs"],
        }

    columns = {"stop_id": F.col("s._id"), **event("ar", "arr"), **event("dp", "dep")}
    return stops.select(
        F.struct("file", "timestamp", "pos").alias("ord"), "eva", *[c.alias(n) for n, c in columns.items()]
    )
