"""Typical timetables: board entries, boards of a date, onward routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast import schemas
from lagcast.functions import text, times
from lagcast.functions.calendar import effective_weekday
from lagcast.operators.history import planned_calls
from lagcast.operators.prepare import complete
from lagcast.session import materialize

ENTRY_KEYS = ["eva", "station_name", "category", "number", "line", "arr_tod", "dep_tod"]


def board_entries(stop_event: DataFrame) -> DataFrame:
    """Trains that recently called at a station, with times and weekday pattern.

    The planned time prefers the departure here.  The newest date is a scalar
    subquery; the grouping combines map-side, so a busy station costs one row
    per entry and task.
    """
    events = complete(
        stop_event.select(
            text.station_id(F.col("eva")).alias("eva"),
            "station_name",
            "train_type",
            "train_number",
            "line_number",
            "arrival_planned_time",
            "departure_planned_time",
            F.coalesce("departure_planned_time", "arrival_planned_time").alias("planned"),
        )
    ).withColumn("day", F.to_date("planned"))
    newest = events.agg(F.max("day").alias("day")).scalar()
    return (
        events.filter(F.col("day") > F.date_sub(newest, P.BOARD_LOOKBACK_DAYS))
        .groupBy(
            "eva",
            "station_name",
            F.col("train_type").alias("category"),
            F.col("train_number").alias("number"),
            F.col("line_number").alias("line"),
            times.minute_of_day(F.col("arrival_planned_time")).alias("arr_tod"),
            times.minute_of_day(F.col("departure_planned_time")).alias("dep_tod"),
        )
        .agg(
            F.expr("bit_or(shiftleft(1, weekday(day)))").alias("weekday_mask"),
            F.max("day").alias("last_seen"),
            F.count("*").alias("runs"),
        )
        .filter(F.col("runs") >= P.BOARD_MIN_RUNS)
    )


def board_position(dep_tod: Column, arr_tod: Column) -> Column:
    return F.coalesce(dep_tod, arr_tod, F.lit(0))


def board_documents(entries: DataFrame) -> DataFrame:
    """One document per station, trains in board order.

    A board lists distinct timetable entries, so its size follows the timetable
    of one station and not the number of runs.
    """
    fields = ["category", "number", "line", "arr_tod", "dep_tod", "weekday_mask"]
    row = F.array(*[F.col(f).cast("string") for f in fields], F.unix_date("last_seen").cast("string"))
    ordered = F.struct(
        board_position(F.col("dep_tod"), F.col("arr_tod")).alias("position"), *fields, row.alias("row")
    )
    return (
        entries.groupBy("eva")
        .agg(F.max("station_name").alias("name"), F.sort_array(F.collect_list(ordered)).alias("kept"))
        .select("eva", F.to_json(F.struct("name", F.col("kept.row").alias("trains"))).alias("document"))
    )


def write_boards(entries: DataFrame, path: str) -> None:
    board_documents(entries).write.mode("overwrite").option("compression", "gzip").json(path)


def read_board_documents(documents: DataFrame) -> DataFrame:
    """Board documents to entries; rows with fewer than seven fields go."""
    row = F.col("row")
    return (
        documents.withColumn("doc", F.from_json("document", schemas.BOARD_DOCUMENT))
        .select("eva", F.col("doc.name").alias("station_name"), F.explode("doc.trains").alias("row"))
        .filter(F.size(row) >= 7)
        .select(
            "eva",
            "station_name",
            row[0].alias("category"),
            row[1].alias("number"),
            row[2].alias("line"),
            row[3].try_cast("int").alias("arr_tod"),
            row[4].try_cast("int").alias("dep_tod"),
            F.coalesce(row[5].try_cast("int"), F.lit(0)).alias("weekday_mask"),
            F.date_from_unix_date(F.coalesce(row[6].try_cast("int"), F.lit(0))).alias("last_seen"),
        )
    )


def plan_board(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Board stops of every request ``(board_id, eva, start, hours, as_of)``.

    A window is cut into hours, and entries meet it by station and hour: a request
    reads the entries of its hours, not all of its station. One train appears once per
    date even if it calls twice.
    """
    end = F.col("start") + F.make_dt_interval(hours=F.col("hours"))
    first_hour = times.at_minute(F.to_date("start"), F.hour("start") * 60)
    hour = F.explode(F.sequence(first_hour, F.col("end"), F.expr("interval 1 hour")))
    dated = requests.withColumn("end", end).withColumn("slot_start", hour).withColumns(
        {"date": F.to_date("slot_start"), "slot": F.hour("slot_start")}
    )
    slotted = entries.withColumn("slot", F.floor(F.coalesce("dep_tod", "arr_tod") / 60).cast("int"))
    dated = dated.withColumn(
        "weekday_bit", F.call_function("shiftleft", F.lit(1), effective_weekday(F.col("date")) - 1)
    )
    timed = (
        slotted.join(dated.drop("slot_start"), ["eva", "slot"])
        .drop("slot")
        .filter(F.col("weekday_mask").bitwiseAND(F.col("weekday_bit")) != 0)
        .filter(F.col("last_seen") >= F.date_sub("as_of", P.BOARD_MAX_AGE_DAYS))
        .withColumns(
            {
                "arr_planned": times.at_minute(F.col("date"), F.col("arr_tod")),
                "dep_planned": times.at_minute(F.col("date"), F.col("dep_tod")),
            }
        )
        .withColumn("anchor", F.coalesce("dep_planned", "arr_planned"))
        .filter((F.col("anchor") >= F.col("start")) & (F.col("anchor") < F.col("end")))
    )
    board_order = [
        board_position(F.col("dep_tod"), F.col("arr_tod")),
        *[F.col(c) for c in ("line", "arr_tod", "dep_tod", "station_name")],
    ]
    first = Window.partitionBy("board_id", "date", "category", "number").orderBy(*board_order)
    return (
        timed.withColumn("rank", F.row_number().over(first))
        .filter("rank = 1")
        .select(
            "board_id",
            F.concat_ws("-", F.lit("syn"), "category", "number", F.col("date").cast("string")).alias("stop_id"),
            "eva",
            "station_name",
            "category",
            "number",
            "line",
            "arr_planned",
            "dep_planned",
            "dep_tod",
        )
    )


def first_stops(stops: DataFrame, limit: int | None = None) -> DataFrame:
    """Stops with their position on each board by departure, else arrival; the first ones if a display sets a limit."""
    by_time = Window.partitionBy("board_id").orderBy(F.coalesce("dep_planned", "arr_planned"), "stop_id")
    placed = stops.withColumn("position", F.row_number().over(by_time))
    return placed if limit is None else placed.filter(F.col("position") <= limit)


def route_after(calls: DataFrame, origins: DataFrame) -> DataFrame:
    """Stations a train reaches after leaving ``(train_key, origin_eva, origin_tod)``.

    ``calls`` holds distinct planned times (``planned_calls``), so a train's window
    does not grow with its runs.  Times are unrolled over two days, so that a frame of minutes
    after each origin also sees past midnight; calls are never paired with calls.
    """
    keys = ["train_key", "origin_eva", "origin_tod"]
    stop = F.struct(F.col("at"), "station_name", "eva")
    unrolled = calls.select(
        "train_key", F.explode(F.array(F.col("tod"), F.col("tod") + 1440)).alias("at"), "station_name", "eva"
    ).select("train_key", "at", stop.alias("stop"))
    asked = origins.select(*keys).distinct().withColumn("at", F.col("origin_tod"))
    ahead = Window.partitionBy("train_key").orderBy("at").rangeBetween(1, P.ROUTE_WINDOW_MIN - 1)
    seen = unrolled.unionByName(asked, allowMissingColumns=True).withColumn("seen", F.collect_list("stop").over(ahead))
    elsewhere = F.filter("seen", lambda s: ~s["eva"].eqNullSafe(F.col("origin_eva")))
    # A station counts where it comes first.
    path = F.array_distinct(F.transform(F.array_sort(elsewhere), lambda s: s["station_name"]))
    return seen.filter("origin_tod is not null").select(*keys, path.alias("path")).filter(F.size("path") > 0)


def resolve_train(labels: DataFrame, index: DataFrame) -> DataFrame:
    """History key of each distinct ``(category, number, line)``: by number, else by line."""
    names = ["category", "number", "line"]
    keys = text.lookup_keys(*[F.col(n) for n in names])
    tried = labels.select(*names).distinct().select(*names, F.posexplode(keys).alias("turn", "train_key"))
    known = tried.join(index.select("train_key").distinct(), "train_key", "left_semi")
    return known.groupBy(*names).agg(F.min_by("train_key", "turn").alias("train_key"))


def with_train_key(stops: DataFrame, index: DataFrame) -> DataFrame:
    """Adds ``train_key``, null for a train without history."""
    names = ["category", "number", "line"]
    found = resolve_train(stops, index).select(*[F.col(n).alias(f"_{n}") for n in names], "train_key")
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return stops.join(found, same, "left").drop(*[f"_{n}" for n in names])


def synthetic_board(entries: DataFrame, requests: DataFrame, runs: DataFrame, calls: DataFrame | None = None) -> DataFrame:
    """Boards of dates without a published plan, with routes from the histories."""
    calls = planned_calls(runs) if calls is None else calls
    stops = materialize(with_train_key(plan_board(entries, requests), calls))
    origins = stops.filter("train_key is not null and dep_tod is not null").select(
        "train_key", F.col("eva").alias("origin_eva"), F.col("dep_tod").alias("origin_tod")
    )
    paths = route_after(calls, origins)
    return (
        stops.join(
            paths.select(
                "train_key",
                F.col("origin_eva").alias("eva"),
                F.col("origin_tod").alias("dep_tod"),
                "path",
            ),
            ["train_key", "eva", "dep_tod"],
            "left",
        )
        .withColumn("dep_path", F.coalesce("path", F.array().cast("array<string>")))
        .drop("path")
    )

