"""Engine inputs derived from generic event and dimension tables.

The rules below turn an event log into stop events, feeds and query tables, so
that every operator can be run and checked on data that grows with the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lagcast.functions import text, times
from lagcast.session import file_system, materialize

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# event type -> (train type, base minute of day)
LINES = {
    "view": ("S", 420),
    "click": ("RE", 540),
    "signup": ("RB", 960),
    "purchase": ("ICE", 1080),
    "error": ("IC", 1425),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def input_version(spark: SparkSession, folder: str, *names: str) -> str:
    """A mark of the files of some tables, by names, sizes and times; no file is opened."""
    marks = []
    for name in names:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/{name}.parquet")
        marks.append(files.agg(F.hex(F.xxhash64(F.array_sort(F.collect_list(F.xxhash64("path", "length", "modificationTime")))))).first()[0])
    return "_".join(marks).lower()


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def event_days(spark: SparkSession, folder: str, parts: int) -> list[DataFrame]:
    """The events in consecutive spans of days, as a feed would bring them."""
    events = table(spark, folder, "events")
    first, last = events.agg(F.min(F.to_date("ts")), F.max(F.to_date("ts"))).first()
    if first is None:
        return [events]
    days = (last - first).days + 1
    place = F.floor(F.date_diff(F.to_date("ts"), F.lit(first)) * parts / F.lit(days))
    return [events.filter(place == i) for i in range(parts)]


def write_named(rows: DataFrame, folder: str) -> None:
    """A Parquet folder ``<name>.parquet`` for each value of the column ``name``.

    ``rebalance`` lets the adaptive planner split a large name over several files.
    """
    spark, temporary = rows.sparkSession, f"{folder}/_named"
    rows.hint("rebalance", "name").write.mode("overwrite").partitionBy("name").parquet(temporary)
    fs, path = file_system(spark, folder)
    for made in fs.globStatus(path(f"{temporary}/name=*")):
        name = made.getPath().getName().removeprefix("name=")
        fs.rename(made.getPath(), path(f"{folder}/{name}.parquet"))
    fs.delete(path(temporary), True)


def closing_events(events: DataFrame, days: int = 10) -> DataFrame:
    """A plan and a change row long after all others: they only move the watermarks on."""
    last = events.agg(F.max("ts").alias("ts")).withColumn("ts", F.expr(f"ts + interval {days} days"))
    kinds = F.explode(F.array(*[F.lit(k) for k in LINES])).alias("event_type")
    return last.select(
        F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(0).cast("long").alias("user_id"), kinds,
        F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).select([F.col(f.name).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EVENTS).fields])


def _choose(slot: int):
    first, *rest = LINES.items()
    chosen = F.when(F.col("event_type") == first[0], first[1][slot])
    for kind, values in rest:
        chosen = chosen.when(F.col("event_type") == kind, values[slot])
    return chosen


def _keyed(events: DataFrame) -> DataFrame:
    return events.withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "train_type": _choose(0),
            "base": _choose(1),
            "num": (F.col("user_id") % 10).cast("int"),
        }
    )


def padded_name(name):
    """``NATION_3`` to ``NATION_03``, so that no name is part of another."""
    return F.regexp_replace(name, r"_(\d)$", "_0$1")


def _as_stop_events(rows: DataFrame, nation: DataFrame, padded: bool = False) -> DataFrame:
    """Needs ``place`` (0..3), ``pt``, ``k``, ``num``; keeps ``event_id`` as ``seq``."""
    delay = F.floor("value") - 10
    jitter = (F.col("event_id") % 60).cast("int")
    stop_at = F.col("pt") + F.make_dt_interval(mins=F.lit(2))
    name = padded_name(F.col("n_name")) if padded else F.col("n_name")
    names = nation.select(F.col("n_nationkey").alias("place"), name.alias("station_name"))
    no_arrival, no_departure = F.col("k") % 25 == 1, F.col("k") % 25 == 2

    def moved(ts, minutes):
        return ts + F.make_dt_interval(mins=minutes.cast("int"), secs=jitter)

    return rows.join(names, "place").select(
        "station_name",
        F.concat(F.lit("0"), (8000 + F.col("place")).cast("string")).alias("eva"),
        "train_type",
        F.col("num").cast("string").alias("train_number"),
        F.when(
            F.col("user_id") % 7 != 0, F.concat("train_type", (F.col("user_id") % 3).cast("string"))
        ).alias("line_number"),
        F.concat_ws("-", "train_type", F.col("num").cast("string")).alias("train_line_ride_id"),
        (F.col("place") + 1).cast("bigint").alias("train_line_station_num"),
        F.when(~no_arrival, F.col("pt")).alias("arrival_planned_time"),
        F.when(~no_arrival, moved(F.col("pt"), delay)).alias("arrival_change_time"),
        F.when(~no_departure, stop_at).alias("departure_planned_time"),
        F.when(~no_departure, moved(stop_at, delay + F.col("k") % 3 - 1)).alias("departure_change_time"),
        (F.col("k") % 20 == 0).alias("is_canceled"),
        F.col("event_id").alias("seq"),
    )


def stop_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stop events with many planned times per train and station."""
    return stop_events_of(table(spark, folder, "events"), table(spark, folder, "nation"))


def stop_events_of(events: DataFrame, nation: DataFrame) -> DataFrame:
    minute = F.col("base") + F.minute("ts") % 30
    rows = _keyed(events).withColumns(
        {"place": F.col("k") % 4, "pt": times.at_minute(F.to_date("ts"), minute)}
    )
    return _as_stop_events(rows, nation)


def network_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stop events with one planned time per train and station.

    Even train numbers call at stations 0 and 1, odd ones at 1, 2 and 3, so some
    trips need a transfer at station 1.
    """
    even = F.col("num") % 2 == 0
    place = F.when(even, F.col("k") % 2).otherwise(1 + F.col("k") % 3)
    minute = F.col("base") % 1200 + F.col("num") * 7 + F.col("place") * 20
    rows = _keyed(table(spark, folder, "events")).withColumn("place", place)
    rows = rows.withColumn("pt", times.at_minute(F.to_date("ts"), minute))
    return _as_stop_events(rows, table(spark, folder, "nation"), padded=True)


def stations(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("*").cast("int").alias("weight")
    )
    return (
        table(spark, folder, "nation")
        .join(customers, "n_nationkey", "left")
        .select(
            (8000 + F.col("n_nationkey")).cast("string").alias("eva"),
            padded_name(F.col("n_name")).alias("name"),
            F.coalesce("weight", F.lit(0)).alias("weight"),
        )
    )


# ---------------------------------------------------------------- feeds

PLAN_KINDS = ("view", "click")


def _feed(events: DataFrame) -> DataFrame:
    keyed = _keyed(events)
    day = F.date_format("ts", "yyMMdd")
    return keyed.withColumns(
        {
            "place": F.col("k") % 4,
            "stop_id": F.concat_ws(
                "-", F.col("user_id").cast("string"), day, (F.col("k") % 4 + 1).cast("string")
            ),
            "ord": F.struct(F.col("ts").alias("ts"), F.col("event_id").alias("id")),
            "plan_time": times.at_minute(F.to_date("ts"), F.col("base") + F.minute("ts") % 30),
        }
    )


def plan_feed(events: DataFrame, nation: DataFrame) -> DataFrame:
    """Plan rows: several per stop id, of which the first counts."""
    names = nation.select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("station"))
    rows = _feed(events.filter(F.col("event_type").isin(*PLAN_KINDS))).join(names, "place")
    line = F.when(F.col("k") % 6 == 0, "").otherwise(F.concat("train_type", (F.col("k") % 3).cast("string")))
    has_arr, has_dep = F.col("k") % 25 != 1, F.col("k") % 25 != 2
    path = F.when(F.col("k") % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("NATION_"), (F.col("k") % 25).cast("string"), F.lit("| |NATION_3")))
    none = F.lit(None).cast("string")
    return rows.select(
        "ord",
        (8000 + F.col("place")).cast("string").alias("eva"),
        "station",
        "stop_id",
        (F.col("k") % 31 != 0).alias("labelled"),
        F.when(F.col("k") % 31 != 0, F.col("train_type")).otherwise("").alias("category"),
        F.when(F.col("k") % 31 != 0, F.col("num").cast("string")).otherwise("").alias("number"),
        has_arr.alias("arr_present"),
        F.when(has_arr, F.col("plan_time")).alias("arr_planned"),
        F.when(has_arr, F.lit("5")).alias("arr_platform"),
        F.when(has_arr, line).alias("arr_line"),
        F.when(has_arr, text.split_route(path)).otherwise(text.split_route(none)).alias("arr_path"),
        has_dep.alias("dep_present"),
        F.when(has_dep, F.col("plan_time") + F.make_dt_interval(mins=F.lit(2))).alias("dep_planned"),
        F.when(has_dep, F.lit("5")).alias("dep_platform"),
        F.when(has_dep, F.concat(F.lit("D"), (F.col("k") % 3).cast("string"))).alias("dep_line"),
        F.when(has_dep, text.split_route(path)).otherwise(text.split_route(none)).alias("dep_path"),
    )


def change_feed(events: DataFrame) -> DataFrame:
    """Change rows with unset times and states in between."""
    rows = _feed(events.filter(~F.col("event_type").isin(*PLAN_KINDS)))
    minutes = F.floor("value").cast("int")
    at = times.at_minute(F.to_date("ts"), F.hour("ts") * 60 + F.minute("ts"))
    changed = F.when(F.col("k") % 5 != 0, at + F.make_dt_interval(mins=minutes))
    status = F.when(F.col("k") % 10 == 3, "c").when(F.col("k") % 10 == 4, "p")
    return rows.select(
        "ord",
        (8000 + F.col("place")).cast("string").alias("eva"),
        "stop_id",
        changed.alias("arr_changed"),
        F.when(F.col("k") % 4 == 0, F.lit("9")).alias("arr_changed_platform"),
        status.alias("arr_status"),
        F.when(F.col("k") % 3 != 0, changed).alias("dep_changed"),
        F.lit(None).cast("string").alias("dep_changed_platform"),
        F.when(F.col("k") % 2 == 0, status).alias("dep_status"),
    )


# ---------------------------------------------------------------- raw log

DOC_SPAN = 4


def _attr(name: str, value):
    return F.coalesce(F.concat(F.lit(f" {name}='"), value, F.lit("'")), F.lit(""))


def _compact(ts):
    return F.date_format(ts, "yyMMddHHmm")


def raw_log(spark: SparkSession, folder: str) -> DataFrame:
    """The two feeds written out as XML documents of up to four stops each."""
    events, nation = table(spark, folder, "events"), table(spark, folder, "nation")
    plan, change = plan_feed(events, nation), change_feed(events)

    def plan_event(tag: str, name: str):
        route = F.nullif(F.array_join(f"{name}_path", "|"), F.lit(""))
        node = F.concat(
            F.lit(f"<{tag}"),
            _attr("pt", _compact(F.col(f"{name}_planned"))),
            _attr("pp", F.col(f"{name}_platform")),
            _attr("l", F.col(f"{name}_line")),
            _attr("ppth", route),
            F.lit("/>"),
        )
        return F.when(F.col(f"{name}_present"), node).otherwise("")

    label = F.when(
        F.col("labelled"),
        F.concat(F.lit("<tl"), _attr("c", F.col("category")), _attr("n", F.col("number")), F.lit("/>")),
    ).otherwise("")
    plan_xml = F.concat(
        F.lit("<s"), _attr("id", F.col("stop_id")), F.lit(">"), label, plan_event("ar", "arr"), plan_event("dp", "dep"), F.lit("</s>")
    )

    def change_event(tag: str, name: str):
        return F.concat(
            F.lit(f"<{tag}"),
            _attr("ct", _compact(F.col(f"{name}_changed"))),
            _attr("cp", F.col(f"{name}_changed_platform")),
            _attr("cs", F.col(f"{name}_status")),
            F.lit("/>"),
        )

    change_xml = F.concat(
        F.lit("<s"), _attr("id", F.col("stop_id")), F.lit(">"), change_event("ar", "arr"), change_event("dp", "dep"), F.lit("</s>")
    )

    def as_log(rows: DataFrame, api: str, xml, head, url) -> DataFrame:
        parts = rows.groupBy("eva", F.floor(F.col("ord.id") / DOC_SPAN).alias("doc")).agg(
            F.min("ord").alias("first"),
            F.array_sort(F.collect_list(F.struct("ord", xml.alias("xml"), head.alias("head")))).alias("s"),
        )
        body = F.concat(
            F.lit("<timetable"), F.col("s")[0]["head"], F.lit(">"), F.array_join(F.col("s.xml"), ""), F.lit("</timetable>")
        )
        return parts.select(
            F.date_format("first.ts", "yyyy-MM-dd").alias("file"),
            F.struct("first.ts", "first.id").alias("timestamp"),
            F.lit(api).alias("api_name"),
            url.alias("url"),
            body.alias("response_data"),
        )

    plan_log = as_log(
        plan,
        "timetables/v1/plan",
        plan_xml,
        _attr("station", F.col("station")),
        F.concat(F.lit("https://host/plan/0"), "eva", F.lit("/"), F.date_format("first.ts", "yyMMdd/HH")),
    )
    change_log = as_log(
        change, "timetables/v1/fchg", change_xml, F.lit(""), F.concat(F.lit("https://host/fchg/0"), "eva")
    )
    return plan_log.unionByName(change_log)


# ---------------------------------------------------------------- query tables

RECENT_FROM = "2024-01-29"


def forecast_queries(runs: DataFrame) -> DataFrame:
    """One query per train and station as of the day after the newest run.

    Odd train numbers carry a live delay.
    """
    newest = runs.agg(F.max("day").alias("day")).scalar()
    places = runs.groupBy("train_type", "train", "eva", "station_name").agg(F.min("tod").alias("tod"))
    number = F.split_part("train", F.lit(" "), F.lit(2))
    as_of = F.date_add(newest, 1)
    return places.select(
        F.concat_ws("|", "eva", "train").alias("query_id"),
        F.col("train_type").alias("category"),
        number.alias("number"),
        F.lit(None).cast("string").alias("line"),
        "eva",
        F.col("station_name").alias("place"),
        times.at_minute(as_of, F.col("tod")).alias("planned"),
        F.when(number.cast("int") % 2 == 1, number.cast("double") * 3).alias("live"),
        as_of.alias("as_of"),
    )


def live_stops(entries: DataFrame, calls: DataFrame, day) -> DataFrame:
    """A live board for one day of the S and RE trains of a timetable."""
    from lagcast.operators.boards import first_stops, plan_board, route_after, with_train_key

    requests = entries.select("eva").distinct().select(
        "eva",
        F.col("eva").alias("board_id"),
        day.cast("timestamp_ntz").alias("start"),
        F.lit(24).alias("hours"),
        day.alias("as_of"),
    )
    stops = materialize(with_train_key(plan_board(entries.filter("category in ('S', 'RE')"), requests), calls))
    paths = route_after(
        calls,
        stops.filter("dep_tod is not null").select("train_key", F.col("eva").alias("origin_eva"), F.col("dep_tod").alias("origin_tod")),
    )
    joined = stops.join(
        paths.select("train_key", F.col("origin_eva").alias("eva"), F.col("origin_tod").alias("dep_tod"), "path"),
        ["train_key", "eva", "dep_tod"],
        "left",
    )
    num = F.col("number").cast("int")

    def late(ts, minutes):
        return ts + F.make_dt_interval(mins=minutes)

    return joined.select(
        F.concat_ws("-", F.lit("live"), "category", "number", "eva").alias("stop_id"),
        "eva",
        "category",
        "number",
        "line",
        "arr_planned",
        F.when(num % 2 == 1, late(F.col("arr_planned"), num)).alias("arr_changed"),
        F.lit(False).alias("arr_cancelled"),
        "dep_planned",
        F.when(num % 3 == 1, late(F.col("dep_planned"), num % 4 * 3)).alias("dep_changed"),
        (num == 5).alias("dep_cancelled"),
        F.coalesce("path", F.array().cast("array<string>")).alias("dep_path"),
    )


def connection_requests(calls: DataFrame, stations: DataFrame, day) -> DataFrame:
    """One request per train and call: change at the next station toward station 3."""
    place = F.col("eva").cast("int") - 8000
    names = stations.select(F.col("eva").alias("next_eva"), F.col("name").alias("transfer"))
    goal = stations.filter("eva = '8003'").select("name").scalar()
    parts = F.split("train_key", "_")
    return (
        calls.groupBy("train_key", "eva").agg(F.min("tod").alias("tod"))
        .filter(place < 3)
        .withColumn("next_eva", (place + 8001).cast("string"))
        .join(names, "next_eva")
        .select(
            F.concat_ws("|", "train_key", "eva").alias("query_id"),
            parts[0].alias("category"),
            parts[1].alias("number"),
            F.lit(None).cast("string").alias("line"),
            "transfer",
            goal.alias("destination"),
            F.lit(5).alias("transfer_minutes"),
            F.when(parts[1].cast("int") % 2 == 0, False).alias("ticket_only"),
            times.at_minute(day, F.col("tod")).alias("start"),
            day.alias("as_of"),
        )
    )


def journey_queries(stations: DataFrame, day) -> DataFrame:
    """Every ordered pair of the four served stations at several hours."""
    served = stations.filter(F.col("eva").between("8000", "8003")).select("eva", "name")
    ends = served.select(F.col("eva").alias("to_key"), F.col("name").alias("to_text"))
    return (
        served.withColumn("to_key", F.explode(F.array(*[F.lit(str(e)) for e in range(8000, 8004)])))
        .join(ends, "to_key")
        .withColumn("hour", F.explode(F.array(*[F.lit(h) for h in (3, 7, 9, 16, 18, 22)])))
        .select(
            F.concat_ws("|", "eva", "to_key", F.col("hour").cast("string")).alias("query_id"),
            F.col("name").alias("from_text"),
            "to_text",
            times.at_minute(day, F.col("hour") * 60).alias("depart"),
            F.when(F.col("hour") % 2 == 0, False).alias("ticket_only"),
            F.lit(None).cast("int").alias("transfer_minutes"),
            day.alias("as_of"),
        )
    )
