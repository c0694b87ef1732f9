"""Named queries over a folder of tables, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import calendar, delays, text, times
from lagcast.functions.student_t import t_cdf, t_quantile
from lagcast.operators import boards, bucket_model, condense, empirical, forecast, history, history_codec, prepare
from lagcast.operators import distribution as D
from lagcast.operators import stations as stations_op
from lagcast.operators import transfer
from lagcast.plans import backtest, connections, journeys, quality
from lagcast.session import configure, materialize, stored_table
from lagcast.sources import derived as S
from lagcast.sources import incremental, raw_log, tables, tiers
from lagcast.streaming import buckets, feeds, overlay, stateful
from lagcast.streaming.partials import new_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATIONS = ["8000", "8001"]


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(configure(spark), folder)

    QUERIES[fn.__name__] = run
    return run


def _ts(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _day(name: str):
    return F.col(name).cast("string").alias(name)


def _r(column, name: str | None = None, digits: int = 6):
    column = F.col(column) if isinstance(column, str) else column
    # Adding zero turns a negative zero into zero.
    return (F.round(column, digits) + F.lit(0.0)).alias(name) if name else F.round(column, digits) + F.lit(0.0)


def _stored_events(spark, d, name: str, derive) -> DataFrame:
    """Stop events written once per version of their inputs, for all that read them.

    Filters of their readers meet stored columns; before, each was pushed down to the log and worked out the
    props, times and delays of every event anew for each of its parts.
    """
    return stored_table(spark, name, S.input_version(spark, d, "events", "nation"), lambda: derive(spark, d))


def _stop_events(spark, d) -> DataFrame:
    return _stored_events(spark, d, "stop_events", S.stop_events)


def _network_events(spark, d) -> DataFrame:
    return _stored_events(spark, d, "network_events", S.network_events)


def _prepared(spark, d) -> DataFrame:
    return prepare.prepare_events(_stop_events(spark, d), tie="seq")


def _runs(spark, d) -> DataFrame:
    return history.history_runs(_prepared(spark, d))


def _stored_runs(spark, d) -> DataFrame:
    """The history as a bucketed table, written once for all forecasts over the same events."""
    return stored_table(spark, "runs", S.input_version(spark, d, "events", "nation"), lambda: _runs(spark, d), empirical.PLACE)


def _network_runs(spark, d) -> DataFrame:
    return history.history_runs(prepare.prepare_events(_network_events(spark, d), tie="seq"))


def _plan_day(spark, d):
    """The day after the newest planned stop of the network."""
    events = prepare.with_delays(S.network_events(spark, d))
    return F.date_add(events.agg(F.max(F.to_date("planned")).alias("day")).scalar(), 1)


# ---------------------------------------------------------------- sources


@query
def stop_events(spark, d):
    """The fact table."""
    events = S.stop_events(spark, d)
    stamps = [c for c in events.columns if c.endswith("_time")]
    return events.select(*[_ts(c) if c in stamps else c for c in events.columns])


@query
def raw_log_documents(spark, d):
    """Documents per API and station number of the URL."""
    log = S.raw_log(spark, d)
    parts = [
        raw_log.documents(log, api).select(F.lit(api).alias("api_name"), "eva", F.length("response_data").alias("size"))
        for api in (raw_log.PLAN_API, raw_log.CHANGE_API)
    ]
    return parts[0].unionByName(parts[1]).groupBy("api_name", "eva").agg(
        F.count("*").alias("documents"), F.min("size").alias("shortest")
    ).select("api_name", "eva", "documents", (F.col("shortest") > 0).alias("filled"))


@query
def xml_plan_stops(spark, d):
    """Plan documents to rows."""
    rows = raw_log.plan_stops(S.raw_log(spark, d))
    return rows.select(
        F.col("ord.timestamp.id").alias("doc_id"),
        F.col("ord.pos").alias("pos"),
        "eva",
        "station",
        "stop_id",
        "labelled",
        "category",
        "number",
        _ts("arr_planned"),
        _ts("dep_planned"),
        "arr_line",
        "dep_line",
        F.array_join("arr_path", "|").alias("arr_path"),
        F.array_join("dep_path", "|").alias("dep_path"),
    )


def _with_damage(log: DataFrame) -> DataFrame:
    """The log with, after each document, a copy cut off before its end and one whose stops have no id."""
    text = F.col("response_data")
    cut = log.withColumn("response_data", text.substr(F.lit(1), F.length(text) - 9))
    nameless = log.withColumn("response_data", F.regexp_replace(text, " id='[^']*'", " id=''"))
    return log.unionByName(cut).unionByName(nameless)


@query
def damaged_documents(spark, d):
    """Malformed documents and stops without an id give no rows."""
    log = _with_damage(S.raw_log(spark, d))
    plans, changes = raw_log.plan_stops(log), raw_log.change_stops(log)
    counted = [rows.groupBy(F.lit(kind).alias("kind"), "stop_id").agg(F.count("*").alias("rows")) for kind, rows in (("plan", plans), ("change", changes))]
    return counted[0].unionByName(counted[1])


@query
def xml_change_stops(spark, d):
    """Change documents to rows."""
    rows = raw_log.change_stops(S.raw_log(spark, d))
    return rows.select(
        F.col("ord.timestamp.id").alias("doc_id"),
        F.col("ord.pos").alias("pos"),
        "eva",
        "stop_id",
        _ts("arr_changed"),
        "arr_changed_platform",
        "arr_status",
        _ts("dep_changed"),
        "dep_status",
    )


def _condensed(events: DataFrame) -> DataFrame:
    stamps = [c for c in events.columns if c.endswith("_time")]
    return events.select(*[_ts(c) if c in stamps else c for c in events.columns])


@query
def xml_condense_day(spark, d):
    """M5: raw log to stop events."""
    return _condensed(condense.condense_day(S.raw_log(spark, d)))


@query
def condense_station_runs(spark, d):
    """The same for whole runs that call at a wanted station."""
    events, nation = S.table(spark, d, "events"), S.table(spark, d, "nation")
    plan = condense.first_plan(S.plan_feed(events, nation))
    return _condensed(condense.condense(plan, condense.fold_changes(S.change_feed(events)), STATIONS))


@query
def plan_first_wins(spark, d):
    """A8."""
    plan = condense.first_plan(S.plan_feed(S.table(spark, d, "events"), S.table(spark, d, "nation")))
    return plan.select("stop_id", "eva", "station", "category", "number", _ts("arr_planned"), _ts("dep_planned"))


@query
def change_last_wins(spark, d):
    """A9."""
    folded = condense.fold_changes(S.change_feed(S.table(spark, d, "events")))
    return folded.select("stop_id", _ts("arr_changed"), "arr_status", _ts("dep_changed"), "dep_status")


def _board_rows(board: DataFrame) -> DataFrame:
    return board.select(
        "stop_id",
        "eva",
        text.label(F.col("category"), F.col("number"), F.col("line")).alias("label"),
        _ts("arr_best"),
        _ts("dep_best"),
        "arr_best_platform",
        "arr_cancelled",
        "dep_cancelled",
        _r(times.live_minutes(F.col("arr_changed"), F.col("arr_planned")), "arr_live"),
        "origin",
        "destination",
    )


def _live_board(spark, d) -> DataFrame:
    events, nation = S.table(spark, d, "events"), S.table(spark, d, "nation")
    return condense.live_board(S.plan_feed(events, nation), S.change_feed(events))


@query
def live_board_merge(spark, d):
    """M9/A10/A11/P35-P38."""
    return _board_rows(_live_board(spark, d))


@query
def current_board_rows(spark, d):
    """Rows not older than five minutes at the middle of the month."""
    now = F.lit("2024-01-15 07:10:00").cast("timestamp_ntz")
    return condense.current_rows(_live_board(spark, d), now).select("stop_id", _ts("dep_best"))


@query
def stations(spark, d):
    """D10."""
    return S.stations(spark, d)


@query
def station_resolve_topk(spark, d):
    """Texts of several lengths against all stations."""
    names = S.stations(spark, d)
    texts = names.select(F.explode(F.array(F.col("name"), F.substring("name", 4, 5), F.upper(F.substring("name", -2, 2)), F.lit(" "))).alias("text"))
    return stations_op.resolve_stations(texts, names, 3).select("text", "eva", "name", "score", "rank")


@query
def route_stations(spark, d):
    """Stations named in routes by normalised name."""
    plan = S.plan_feed(S.table(spark, d, "events"), S.table(spark, d, "nation"))
    stops = plan.select(F.explode("dep_path").alias("stop_name")).groupBy("stop_name").agg(F.count("*").alias("n"))
    named = stations_op.stations_by_name(S.stations(spark, d).withColumn("name", F.regexp_replace("name", "_0", "_")))
    return stops.withColumn("norm", text.normal_name(F.col("stop_name"))).join(named, "norm").select(
        "stop_name", "eva", "weight", "n"
    )


@query
def stale_partitions(spark, d):
    """Days whose event count differs from what was processed."""
    days = S.table(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("version"))
    done = days.filter(F.col("day") < S.RECENT_FROM).withColumn(
        "version", F.when(F.substring("day", -1, 1) == "7", F.col("version") - 1).otherwise(F.col("version"))
    )
    return tiers.stale_partitions(days, done, ["day", "version"])


def _metas(spark, d):
    events = S.table(spark, d, "events").agg(
        F.max(F.to_date("ts")).cast("string").alias("through"), F.countDistinct("user_id").cast("string").alias("trains")
    )
    base = events.select(F.col("through").alias("generated"), "trains")
    recent = events.select(F.col("through").alias("recent_through"))
    bundled = events.select(F.lit("2023-12-01").alias("generated"), F.lit("7").alias("trains"))
    return base, recent, bundled


@query
def tier_staleness(spark, d):
    """The recent tier is behind, the base is current."""
    base, recent, bundled = _metas(spark, d)
    remote = base.withColumn("recent_through", F.col("generated"))
    old = recent.select(F.lit("2024-01-02").alias("recent_through"))
    return tiers.stale_tiers(remote, base, old, bundled)


@query
def meta_in_use(spark, d):
    """Downloaded base with recent days."""
    base, recent, bundled = _metas(spark, d)
    return tiers.meta_in_use(base, recent, bundled)


# ---------------------------------------------------------------- prepare and history


@query
def train_identity_key(spark, d):
    """P1-P4/P38."""
    events = prepare.identified(S.stop_events(spark, d))
    line = F.coalesce("line_number", F.lit(""))
    return events.groupBy("eva", "identity", "train_type", "train_number", "line_number").agg(F.count("*").alias("n")).select(
        "eva",
        "identity",
        text.train_key(F.concat(F.lit("(x) "), "identity", F.lit("/"), line)).alias("train_key"),
        F.array_join(text.lookup_keys(F.col("train_type"), F.col("train_number"), F.col("line_number")), ",").alias("keys"),
        text.label(F.col("train_type"), F.col("train_number"), F.col("line_number")).alias("label"),
        "n",
    )


@query
def semi_join_station_trains(spark, d):
    """Whole trains that call at a wanted station."""
    kept = prepare.trains_calling_at(prepare.identified(S.network_events(spark, d)), ["08002"])
    return kept.groupBy("identity", "eva").agg(F.count("*").alias("n"))


@query
def prev_stop_delay(spark, d):
    """W1/P11."""
    return _prepared(spark, d).select("seq", _day("service_day"), "train_line_station_num", "prev_delay")


@query
def prepared_events(spark, d):
    """M1."""
    return _prepared(spark, d).select(
        "seq", "station_name", "eva", "identity", "line_number", "is_canceled", "arr_delay", "dep_delay", "prev_delay", _day("day"), "tod"
    )


@query
def history_runs(spark, d):
    """The flat run table."""
    return _runs(spark, d).withColumn("day", F.col("day").cast("string"))


@query
def train_lines(spark, d):
    """Train-level fields, last filled line."""
    return history.train_lines(_runs(spark, d))


@query
def history_index(spark, d):
    """S14/A7."""
    return history.history_index(_runs(spark, d))


@query
def build_metadata(spark, d):
    """S15/D21."""
    runs = _runs(spark, d)
    recent = F.col("day") >= S.RECENT_FROM
    sources = runs.select(
        F.when(~recent, F.date_format("day", "yyyy-MM")).alias("month"), F.when(recent, F.col("day").cast("string")).alias("recent_day")
    )
    meta = history.build_metadata(runs, sources, STATIONS)
    return meta.select(
        F.array_join("stations", ",").alias("stations"), F.array_join("months", ",").alias("months"), "trains", "recent_from", "recent_through"
    )


@query
def history_nested_columnar(spark, d):
    """M3 encode: W3, W5, W6, A32, A33."""
    blocks = history_codec.encode_history(_runs(spark, d))
    lists = ["tod", "days", "t", "a", "d", "p", "c"]

    def flat(c):
        filled = F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
        return filled.alias(c)

    return blocks.select("train_key", "station_name", "block", "eva", *[flat(c) for c in lists])


def _run_bag(runs: DataFrame, *keys: str) -> DataFrame:
    fields = ["eva", "day", "tod", "arr_delay", "dep_delay", "prev_delay", "cancelled"]
    return runs.groupBy(*keys, *fields).agg(F.count("*").alias("n")).withColumn("day", F.col("day").cast("string"))


@query
def history_round_trip(spark, d):
    """M3 decode of encode with copies of a run over several blocks: the same runs, departures filled."""
    blocks = history_codec.encode_history(_runs(spark, d), slice_runs=1)
    return _run_bag(history_codec.decode_history(blocks), "train_key", "station_name")


@query
def history_json_round_trip(spark, d):
    """History documents written and read back."""
    runs = _runs(spark, d)
    documents = history_codec.history_documents(history_codec.encode_history(runs), history.train_lines(runs))
    back = history_codec.read_history_documents(documents.select("train_key", "block", "document"), ["train_key", "block"])
    return _run_bag(back, "train_key", "station_name")


@query
def history_legacy_rows(spark, d):
    """Documents in the row layout, one per run, some of them garbage."""
    runs = _runs(spark, d).withColumn("id", F.monotonically_increasing_id())
    row = F.array(
        F.col("day").cast("string"),
        times.clock(F.col("tod")),
        *[F.col(c).cast("string") for c in ("arr_delay", "dep_delay", "prev_delay")],
        F.col("cancelled").cast("int").cast("string"),
    )
    short = F.when(F.col("tod") % 7 == 0, F.slice(row, 1, 4)).otherwise(row)
    station = F.struct("eva", F.array(short).alias("runs"))
    document = F.to_json(F.struct(F.col("train"), F.map_from_arrays(F.array("station_name"), F.array(station)).alias("stations")))
    garbled = F.when(F.col("tod") % 11 == 0, F.lit("not json")).otherwise(document)
    back = history_codec.read_history_documents(runs.select("id", "train_key", garbled.alias("document")), ["id", "train_key"])
    return _run_bag(back, "train_key", "station_name")


def _tiers(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    recent = runs.filter(F.col("day") >= S.RECENT_FROM)
    for c in ("arr_delay", "dep_delay"):
        recent = recent.withColumn(c, F.col(c) + 1)
    return runs, recent


@query
def overlay_recent(spark, d):
    """M4/J4/U3."""
    return _run_bag(history.overlay_recent(*_tiers(_runs(spark, d))), "train_key", "station_name")


def _delayed(events: DataFrame) -> DataFrame:
    """The same stops, each a minute later than was known."""
    late = {c: F.col(c) + F.expr("interval 1 minute") for c in ("arrival_change_time", "departure_change_time")}
    return events.withColumns(late)


@query
def incremental_rebuild(spark, d):
    """A store of runs after some days' events were replaced; only these days are read and swapped in."""
    folder = new_folder(spark, "daily")
    events, day = S.stop_events(spark, d), incremental.event_service_day()
    tables.write_daily(events, f"{folder}/events", day)
    incremental.rebuild_runs(spark, f"{folder}/events", f"{folder}/store", tie="seq")
    tables.write_daily(_delayed(events.filter(day >= S.RECENT_FROM)), f"{folder}/events", day)
    incremental.rebuild_runs(spark, f"{folder}/events", f"{folder}/store", tie="seq")
    return _run_bag(incremental.stored_runs(spark, f"{folder}/store"), "train_key", "station_name")


@query
def monthly_and_daily_files(spark, d):
    """Files of months and of recent days read as one table, tagged by their names."""
    folder = new_folder(spark, "files")
    events = S.stop_events(spark, d).drop("seq").withColumn("file_day", F.coalesce(incremental.event_service_day(), F.lit("2024-01-01").cast("date")))
    recent = F.col("file_day") >= S.RECENT_FROM
    S.write_named(events.filter(~recent).withColumn("name", F.date_format("file_day", "'data-'yyyy-MM")).drop("file_day"), folder)
    S.write_named(events.filter(recent).withColumn("name", F.date_format("file_day", "'data-recent-'yyyy-MM-dd")).drop("file_day"), folder)
    tagged = tables.with_source_file(tables.read_stop_events(spark, f"{folder}/*.parquet"))
    return tagged.groupBy("source_file", "month", "recent_day").agg(
        F.count("*").alias("events"), F.countDistinct("train_line_ride_id").alias("rides"), F.sum(F.col("is_canceled").cast("int")).alias("cancelled")
    )


@query
def daily_table(spark, d):
    """Condensed events by service day, written, partly rewritten, and read back."""
    folder, day = new_folder(spark, "daily"), incremental.event_service_day()
    events = S.stop_events(spark, d).drop("seq").filter(day.isNotNull())
    tables.write_daily(events, folder, day)
    tables.write_daily(events.filter((day >= S.RECENT_FROM) & (F.col("train_type") == "S")), folder, day)
    return spark.read.parquet(folder).groupBy(F.col("service_day").cast("string").alias("service_day")).agg(
        F.count("*").alias("events"), F.countDistinct("train_number").alias("trains")
    )


@query
def station_lines(spark, d):
    """Stations from lines of text, with short lines and bad weights."""
    folder = new_folder(spark, "stations")
    named = S.stations(spark, d)
    weight = F.when(F.col("weight") % 2 == 0, F.col("weight").cast("string")).otherwise(F.concat(F.lit("x"), "weight"))
    whole = named.select(F.concat_ws(";", "eva", "name", weight).alias("value"))
    whole.unionByName(named.select(F.concat_ws(";", "eva", "name").alias("value"))).write.text(folder)
    return tables.read_stations(spark, folder)


@query
def scores_file(spark, d):
    """Scores of all runs by product group, written as JSON and read back."""
    path = f"{new_folder(spark, 'scores')}/scores"
    runs = _runs(spark, d).filter("not cancelled and arr_delay is not null")
    bucket = delays.product_bucket(F.split("train_key", "_")[0])
    scores = runs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("arr_delay")), 3).alias("mae"))
    tables.write_scores(scores, path)
    return spark.read.schema("bucket string, n long, mae double").json(path)


# ---------------------------------------------------------------- calendar and boards


@query
def calendar_holidays(spark, d):
    """C1/C2/C4 over all order dates."""
    days = S.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    return days.select(
        _day("d"),
        calendar.easter_sunday(F.year("d")).cast("string").alias("easter"),
        calendar.is_holiday(F.col("d")).alias("holiday"),
        calendar.is_holiday(F.col("d"), bavaria=True).alias("bavarian"),
        calendar.effective_weekday(F.col("d")).alias("weekday"),
    )


@query
def timetable_change(spark, d):
    """C3/P44."""
    days = S.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
    change = calendar.next_timetable_change(F.col("d"))
    return days.select(_day("d"), change.cast("string").alias("change"), (F.date_add("d", 30) >= change).alias("crosses"))


@query
def board_entries(spark, d):
    """M6/A2-A4."""
    return boards.board_entries(S.network_events(spark, d)).withColumn("last_seen", F.col("last_seen").cast("string"))


@query
def board_documents(spark, d):
    """Boards written and read back, with the trains per station."""
    entries = boards.board_entries(S.network_events(spark, d))
    back = boards.read_board_documents(boards.board_documents(entries))
    return back.withColumn("last_seen", F.col("last_seen").cast("string"))


@query
def board_station_count(spark, d):
    """A5."""
    return boards.board_entries(S.stop_events(spark, d)).agg(
        F.count("*").alias("entries"), F.countDistinct("eva").alias("stations")
    )


def _board_requests(spark, d) -> DataFrame:
    day = _plan_day(spark, d)
    return S.stations(spark, d).withColumn("hour", F.explode(F.array(*[F.lit(h) for h in (3, 7, 17, 23)]))).select(
        F.concat_ws("|", "eva", F.col("hour").cast("string")).alias("board_id"),
        "eva",
        times.at_minute(day, F.col("hour") * 60).alias("start"),
        F.lit(5).alias("hours"),
        day.alias("as_of"),
    )


@query
def synthetic_board(spark, d):
    """M7/J13/P20-P22/A11/O5/O6."""
    entries = boards.board_entries(S.network_events(spark, d))
    stops = boards.first_stops(boards.plan_board(entries, _board_requests(spark, d)))
    return stops.select("board_id", "stop_id", "line", _ts("arr_planned"), _ts("dep_planned"), "position")


@query
def route_after_stop(spark, d):
    """M8/A31 from every planned call of the many-times table."""
    calls = history.planned_calls(_runs(spark, d))
    origins = calls.select("train_key", F.col("eva").alias("origin_eva"), F.col("tod").alias("origin_tod"))
    routes = boards.route_after(calls, origins)
    return routes.select("train_key", "origin_eva", "origin_tod", F.array_join("path", "|").alias("path"))


@query
def timetable_check(spark, d):
    """Plan feed against the histories."""
    plan = S.plan_feed(S.table(spark, d, "events"), S.table(spark, d, "nation")).filter("labelled")
    asked = plan.select(
        text.train_key(text.train_identity(F.col("category"), F.col("number"))).alias("train_key"),
        F.lower("station").alias("station_name"),
        (times.minute_of_day(F.coalesce("arr_planned", "dep_planned")) + 7).alias("tod"),
    )
    return quality.timetable_check(asked, history.planned_calls(_runs(spark, d))).select(
        "train_key", "station_name", "tod", "gap", "mismatch"
    )


# ---------------------------------------------------------------- distributions


def _located(spark, d) -> tuple[DataFrame, DataFrame]:
    """Runs and the forecast queries placed in them."""
    runs = _stored_runs(spark, d)
    queries = materialize(S.forecast_queries(runs)).withColumn("train_key", text.train_key(text.train_identity(F.col("category"), F.col("number"))))
    placed = forecast.match_station(queries, history.station_index(runs))
    return runs, placed.withColumn("tod", times.minute_of_day(F.col("planned")))


def _blind(spark, d) -> DataFrame:
    runs, queries = _located(spark, d)
    return empirical.empirical_points(runs, queries.withColumn("live", F.lit(None).cast("double")))


def _live(spark, d) -> DataFrame:
    return empirical.empirical_points(*_located(spark, d))


@query
def cancel_rate(spark, d):
    """A14/P17."""
    rates = empirical.cancel_rates(*_located(spark, d))
    return rates.select("query_id", _r("cancel_rate", "cancel_rate"), "calls")


@query
def effective_n(spark, d):
    """A15/A16/F11."""
    sizes = empirical.sample_sizes(_live(spark, d))
    return sizes.select("query_id", "sample", _r("effective_n", "effective_n"), "on_live")


@query
def empirical_blind_quantiles(spark, d):
    """M10/J9/A18."""
    return D.quantiles(_blind(spark, d), ["query_id"], {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query
def empirical_cdf_within5(spark, d):
    """A17/A36."""
    points = _blind(spark, d)
    return points.groupBy("query_id").agg(_r(D.cdf_of(5.0), "p_within5"), _r(D.cdf_of(0.0), "p_on_time"))


@query
def empirical_delta_quantiles(spark, d):
    """M11/F12."""
    return D.quantiles(_live(spark, d), ["query_id"], {"q10": 0.1, "q50": 0.5, "q90": 0.9})


@query
def distribution_histogram(spark, d):
    """M25/A35/F7."""
    bins = D.histogram(_live(spark, d), ["query_id"])
    return bins.select("query_id", "bin", "width", _r("share", "share"), times.tick_step(F.col("width") * 31).alias("tick"))


@query
def train_class_time_band(spark, d):
    """P39-P41/P23/P46."""
    events = prepare.with_delays(S.stop_events(spark, d))
    kinds = F.array(*[F.lit(c) for c in ("WB", "ice", "s", "Ag", "ALX", "4x", "")])
    tagged = events.withColumn("category", F.explode(F.concat(F.array("train_type"), kinds)))
    return tagged.groupBy(
        "category",
        delays.train_class(F.col("category")).alias("train_class"),
        delays.product_bucket(F.col("category")).alias("bucket"),
        delays.time_band(F.col("planned")).alias("band"),
        delays.ticket_covers(F.col("category")).alias("covered"),
    ).agg(F.count("*").alias("n"))


@query
def departure_defaults(spark, d):
    """Requested departures with missing parts."""
    e = S.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    now = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    depart = times.departure_or_default(
        F.when(F.col("k") % 2 == 0, F.col("k") % 24),
        F.when(F.col("k") % 4 == 0, F.col("k") % 60),
        F.when(F.col("k") % 3 == 0, F.date_add(F.to_date("ts"), F.col("k") % 5)),
        now,
    )
    return e.withColumns({"depart": depart, "now": now}).select(
        "event_id",
        _ts("depart"),
        times.trip_minutes(F.col("now"), F.col("depart")).alias("travel"),
        times.delay_clock(F.col("depart"), F.floor("value").cast("double")).alias("clock"),
    )


# ---------------------------------------------------------------- bucket model and forecast


def _stats(spark, d) -> DataFrame:
    # Statistics need no previous delay, so no lag is run for them.
    whole = prepare.complete(prepare.with_delays(_stop_events(spark, d)))
    return bucket_model.bucket_stats(bucket_model.observations(whole))


@query
def bucket_stats(spark, d):
    """A25/D14."""
    return _stats(spark, d).select("train_class", "time_band", "n", _r("mean", "mean"), _r("m2", "m2", 3))


def _predictive(spark, d) -> DataFrame:
    wanted = _prepared(spark, d).select(
        delays.train_class(F.col("train_type")).alias("train_class"),
        F.explode(F.array(*[F.lit(b) for b in ("MORNING_PEAK", "MIDDAY", "EVENING_PEAK", "NIGHT")])).alias("time_band"),
    ).distinct()
    return bucket_model.posterior_predictive(wanted, _stats(spark, d))


@query
def nig_posterior(spark, d):
    """A26/M14/J18."""
    return _predictive(spark, d).select("train_class", "time_band", _r("df", "df"), _r("loc", "loc"), _r("scale", "scale"))


@query
def live_anchor(spark, d):
    """M15."""
    lived = _predictive(spark, d).withColumn("live", F.when(F.col("time_band") != "MIDDAY", F.length("time_band") * 1.5))
    return bucket_model.anchor_live(lived).select("train_class", "time_band", _r("df", "df"), _r("loc", "loc"), _r("scale", "scale"))


@query
def student_t_quantiles(spark, d):
    """Quantiles, and the probabilities they map back to."""
    params = [F.col(c) for c in ("df", "loc", "scale")]
    rows = _predictive(spark, d).withColumn("p", F.explode(F.array(*[F.lit(p) for p in (0.1, 0.5, 0.9)])))
    rows = rows.withColumn("x", t_quantile(F.col("p"), *params)).withColumn("back", t_cdf(F.col("x"), *params))
    return rows.select("train_class", "time_band", "p", _r("x", "x"), _r("back", "back"))


def _forecast(spark, d) -> forecast.Forecasts:
    runs = _stored_runs(spark, d)
    queries = materialize(S.forecast_queries(runs))
    # Trains nobody has seen fall back to the bucket model.
    unseen = queries.filter("number = '3'").withColumns({"query_id": F.concat(F.lit("unseen|"), "query_id"), "number": F.lit("99")})
    return forecast.forecast(queries.unionByName(unseen), runs, _stats(spark, d))


@query
def forecast_source(spark, d):
    """M17/J5/J7."""
    made = _forecast(spark, d).summary
    return made.select(
        "query_id",
        "source",
        "run_count",
        _r("effective_runs", "effective_runs"),
        _r("cancel_probability", "cancel_probability"),
        *[_r(c, c) for c in ("df", "loc", "scale")],
    )


@query
def forecast_cards(spark, d):
    """A36/D16 with both kinds of distribution; the flagship."""
    return _cards(forecast.forecast_cards(_forecast(spark, d)))


@query
def forecast_cards_seen(spark, d):
    """A36/D16 of the trains with enough history."""
    return _cards(forecast.forecast_cards(_forecast(spark, d)).filter("source <> 'PRIOR'"))


def _cards(cards: DataFrame) -> DataFrame:
    return cards.select(
        "query_id",
        "source",
        *[_r(c, c) for c in ("median", "q10", "q90", "p_within5")],
        times.delay_clock(F.col("planned"), F.col("median")).alias("median_clock"),
    )


# ---------------------------------------------------------------- transfers and journeys


def _network(spark, d, live: bool = True) -> connections.Network:
    version = S.input_version(spark, d, "events", "nation")
    runs = stored_table(spark, "network_runs", version, lambda: _network_runs(spark, d), empirical.PLACE)
    entries = stored_table(spark, "entries", version, lambda: boards.board_entries(_network_events(spark, d)), ["eva"])
    day = _day_after(runs)
    stops = materialize(S.live_stops(entries, history.planned_calls(runs), day)) if live else None
    return connections.Network(runs, entries, materialize(S.stations(spark, d)), stops)


def _day_after(runs: DataFrame):
    """Day after the newest stored run."""
    return F.date_add(runs.agg(F.max("day")).scalar(), 1)


def _connections(spark, d) -> connections.Connections:
    network = _network(spark, d)
    requests = materialize(S.connection_requests(network.calls, network.stations, _day_after(network.runs)))
    return connections.plan_connections(requests, network)


@query
def connection_outcome(spark, d):
    """M20/M26/A29/A30."""
    outcome = _connections(spark, d).outcome
    return outcome.select(
        "query_id",
        "status",
        _ts("feeder_planned"),
        _ts("reference_arrival"),
        _r("catch_probability", "catch_probability"),
        _r("miss_probability", "miss_probability"),
    )


@query
def catch_and_miss(spark, d):
    """Chance of each candidate."""
    listed = _connections(spark, d).transfers.candidates
    return listed.select("query_id", "cand_id", _ts("dep_planned"), _ts("arr_planned"), _r("board_probability", "board_probability"))


@query
def transfer_propagation(spark, d):
    """Arrival distribution through the transfer."""
    points = _connections(spark, d).transfers.points
    return points.select("query_id", _r("value", "value"), _r("weight", "weight"))


def _all_departures(spark, d) -> tuple[DataFrame, connections.Network]:
    """Every planned call of the network as a candidate toward station 3."""
    network = _network(spark, d, live=False)
    day = _day_after(network.runs)
    names = network.stations.select("eva", F.col("name").alias("transfer_name"))
    goal = network.stations.filter("eva = '8003'").select("name").scalar()
    parts = F.split("train_key", "_")
    rows = network.calls.join(names, "eva").select(
        F.lit("all").alias("query_id"),
        F.concat_ws("|", "train_key", "eva", F.col("tod").cast("string")).alias("cand_id"),
        parts[0].alias("category"),
        parts[1].alias("number"),
        F.lit(None).cast("string").alias("line"),
        times.at_minute(day, F.col("tod")).alias("dep_planned"),
        F.when(parts[1] == "7", 4.5).alias("dep_live"),
        (parts[1] == "9").alias("dep_cancelled"),
        F.col("eva").alias("transfer_eva"),
        "transfer_name",
        goal.alias("destination"),
        day.alias("as_of"),
    )
    return materialize(rows), network


@query
def joint_candidate_runs(spark, d):
    """Joint delays of every call with the destination."""
    rows, network = _all_departures(spark, d)
    made = transfer.build_candidates(rows, network.runs, network.index)
    sums = made.joint.groupBy("cand_id").agg(
        F.sum("n").alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * (F.col("arr") - F.col("dep"))).alias("gain")
    )
    return made.rows.join(sums, "cand_id", "left").select(
        "cand_id", _ts("arr_planned"), _r("cancel_rate", "cancel_rate"), "joint_runs", "n", _r("w", "w"), _r(F.col("gain") / F.col("w"), "gain")
    )


def _departures(spark, d, network) -> DataFrame:
    queries = materialize(S.journey_queries(network.stations, _day_after(network.runs)))
    placed = journeys.place_queries(queries, network.stations)
    boards_ = network.boards(
        placed.filter("not same").select(
            F.col("from_eva").alias("eva"), F.col("depart").alias("start"), F.lit(P.JOURNEY_BOARD_HOURS).alias("hours"), "as_of"
        )
    )
    return journeys.usable_departures(placed, boards_)


@query
def fare_filter_departures(spark, d):
    """P23/P24/P25/J14/U4."""
    return _departures(spark, d, _network(spark, d)).select("query_id", "stop_id", _ts("dep_planned"), "direct", "typical")


def _itinerary(rows: DataFrame, *more) -> DataFrame:
    return rows.select(
        "query_id",
        "stop_id",
        "transfer_station",
        _ts("dep_planned"),
        _ts("reference_arrival"),
        *[_r(c, c, 4) for c in ("median", "q10", "q90", "catch_probability", "miss_probability")],
        *more,
    )


@query
def direct_itineraries(spark, d):
    """The first three direct trains."""
    network = _network(spark, d)
    return _itinerary(journeys.direct_itineraries(_departures(spark, d, network), network, P.MAX_DIRECT))


@query
def itinerary_top5(spark, d):
    """Ranked itineraries of every journey query."""
    network = _network(spark, d)
    made = journeys.plan_journeys(materialize(S.journey_queries(network.stations, _day_after(network.runs))), network)
    return _itinerary(made.itineraries, "place", "travel_minutes")


@query
def journey_outcome(spark, d):
    """Status of every journey query."""
    network = _network(spark, d)
    return journeys.plan_journeys(materialize(S.journey_queries(network.stations, _day_after(network.runs))), network).outcome


@query
def not_found_outcomes(spark, d):
    """Journeys and connections that name a station that is not there."""
    network = _network(spark, d)
    hour = F.element_at(F.split("query_id", r"\|"), -1)
    asked = S.journey_queries(network.stations, _day_after(network.runs)).filter("from_text <> to_text").withColumns(
        {
            "from_text": F.when(hour == "3", F.concat(F.lit("Quay of "), "from_text")).otherwise(F.col("from_text")),
            "to_text": F.when(hour.isin("3", "7", "9"), F.lit("Quay")).otherwise(F.col("to_text")),
        }
    )
    journey = journeys.plan_journeys(materialize(asked), network).outcome.select(
        F.lit("journey").alias("kind"), "query_id", F.when(F.col("status").endswith("NOT_FOUND"), F.col("status")).otherwise("FOUND").alias("status")
    )
    requests = S.connection_requests(network.calls, network.stations, _day_after(network.runs))
    lost = requests.withColumn("transfer", F.when(F.col("number").isin("1", "4"), "Quay").otherwise(F.col("transfer")))
    connection = connections.plan_connections(lost, network).outcome.select(
        F.lit("connection").alias("kind"), "query_id", F.when(F.col("status").endswith("NOT_FOUND"), F.col("status")).otherwise("FOUND").alias("status")
    )
    return journey.unionByName(connection)


#: Names as travellers write them: part of a name, a name with more around it, another case.
LOOSE_NAMES = ("nation_0", "NATION_03", "Nation_03 (tief)", "ation_02", "NATION_1", "Quay")


@query
def loose_destinations(spark, d):
    """The station of a train's history that a loosely written destination means."""
    index = history.station_index(_network_runs(spark, d))
    asked = index.select("train_key").distinct().withColumn("destination", F.explode(F.array(*[F.lit(n) for n in LOOSE_NAMES])))
    one, both = (transfer.match_destination(asked, index, "destination", name, None, way) for name, way in (("contained", False), ("either", True)))
    return one.join(both, ["train_key", "destination"])


@query
def loose_routes(spark, d):
    """Routes that reach a loosely written destination."""
    calls = history.planned_calls(_network_runs(spark, d))
    origins = calls.select("train_key", F.col("eva").alias("origin_eva"), F.col("tod").alias("origin_tod"))
    routes = boards.route_after(calls, origins).withColumn("destination", F.explode(F.array(*[F.lit(n) for n in LOOSE_NAMES])))
    ways = {name: text.route_reaches(F.col("path"), F.col("destination"), way) for name, way in (("contained", False), ("either", True))}
    return routes.select("train_key", "origin_eva", "origin_tod", "destination", *[c.alias(n) for n, c in ways.items()])


@query
def trains_by_line(spark, d):
    """Trains without a known number found by their line, and stations by name where the number is unknown."""
    runs = _runs(spark, d)
    # The history of a line, as a feed without train numbers would make it.
    lines = runs.filter("line_number is not null").withColumn("train_key", text.train_key(F.col("line_number")))
    index = history.station_index(lines)
    labels = runs.select(F.col("train_type").alias("category"), F.col("line_number").alias("line")).distinct().withColumn("number", F.lit("9999"))
    known = boards.with_train_key(labels, index)
    asked = known.filter("train_key is not null").join(index.select("train_key", F.upper("station_name").alias("place")), "train_key").select(
        F.concat_ws("|", "category", "line", "place").alias("query_id"), "train_key", F.lit("0").alias("eva"), "place"
    )
    return forecast.match_station(asked, index).select("query_id", "train_key", "station_name")


# ---------------------------------------------------------------- backtest


def _evaluation(spark, d) -> DataFrame:
    stations = ["8000", "8001", "8002", "8003"]
    # Trains that call nowhere there are left out before the lag.
    prepared = prepare.prepare_events(S.stop_events(spark, d), stations, tie="seq", need_train=False)
    return materialize(backtest.evaluation_rows(prepared, stations))


@query
def backtest_pairs(spark, d):
    """Earlier runs and weights each evaluation state sees."""
    rows = _evaluation(spark, d)
    names = ["w_hl30_wd2", "w_window35", "w_hl14_wd2_hol"]
    states, _ = backtest.with_states(backtest.evaluated(rows))
    # Sums over all delays: only whether there was a previous one is kept of them.
    runs = rows.withColumns({"delay": F.lit(0), "prev": F.when(F.col("prev").isNotNull(), 0)})
    cells = backtest.blind_cells(states, backtest.fold_history(runs, states), names)
    sums = cells.groupBy("state").agg(
        F.sum("n").alias("runs"), F.max("known").alias("known"), *[_r(F.sum(w), w) for w in names]
    )
    return sums.join(states, "state").drop("state").withColumn("day", F.col("day").cast("string"))


@query
def backtest_crps(spark, d):
    """Scores of every variant per evaluation row."""
    scores = backtest.score_rows(_evaluation(spark, d))
    return scores.select(
        "variant",
        "scenario",
        *[_day("day") if c == "day" else c for c in backtest.STATE],
        "live",
        "y",
        "c",
        *[_r(c, c) for c in ("crps", "pinball10", "pinball50", "pinball90")],
        "covered80",
    )


@query
def backtest_scores_grouping_sets(spark, d):
    """M23/A22/A23."""
    return backtest.backtest(_evaluation(spark, d))


# ---------------------------------------------------------------- streams


@query
def stream_change_fold(spark, d):
    """T1."""
    folded = feeds.fold_change_stream(S.change_feed(S.event_stream(spark, d)))
    return folded.select("stop_id", _ts("arr_changed"), "arr_status", _ts("dep_changed"), "dep_status")


@query
def stream_first_plan(spark, d):
    """T2."""
    plan = feeds.first_plan_stream(S.plan_feed(S.event_stream(spark, d), S.table(spark, d, "nation")))
    return plan.select("stop_id", "eva", "station", "category", "number", _ts("arr_planned"), _ts("dep_planned"))


@query
def stream_live_board(spark, d):
    """T3."""
    events = S.event_stream(spark, d)
    return _board_rows(feeds.live_board_stream(S.plan_feed(events, S.table(spark, d, "nation")), S.change_feed(events)))


def _resumed(spark, d, name: str, make, parts: int = 3, close: bool = False, mode: str = "update") -> str:
    """Results of a streaming query over the events of several spans of days: stopped after each and resumed from its checkpoint."""
    folder = new_folder(spark, name)
    arrivals = S.event_days(spark, d, parts)
    if close:
        arrivals.append(S.closing_events(S.table(spark, d, "events")))
    for part in arrivals:
        part.write.mode("append").parquet(f"{folder}/events")
        stateful.save_updates(make(S.event_stream(spark, f"{folder}/events", "*.parquet")), folder, mode=mode).awaitTermination()
    return folder


@query
def stream_change_states(spark, d):
    """Last known values in per-stop state with timers, resumed twice."""
    with_time = lambda events: stateful.change_states(S.change_feed(events), F.col("ord.ts"))
    folder = _resumed(spark, d, "change-states", with_time)
    folded = stateful.newest_updates(spark, folder)
    return folded.select("stop_id", _ts("arr_changed"), "arr_status", _ts("dep_changed"), "dep_status")


@query
def stream_first_plan_watermark(spark, d):
    """First plans per day of event time under a watermark, resumed twice."""
    nation = S.table(spark, d, "nation")
    folder = _resumed(spark, d, "first-plans", lambda events: stateful.first_plans(S.plan_feed(events, nation), F.col("ord.ts")).drop("span"))
    return stateful.newest_updates(spark, folder).select("stop_id", "eva", "station", "category", "number", _ts("arr_planned"), _ts("dep_planned"))


@query
def stream_condense(spark, d):
    """Plan and change streams joined within a watermark to stop events."""
    nation = S.table(spark, d, "nation")
    time = F.col("ord.ts")
    folder = _resumed(spark, d, "condense", lambda events: stateful.stop_events(S.plan_feed(events, nation), S.change_feed(events), time, time), close=True, mode="append")
    return _condensed(spark.read.parquet(f"{folder}/data").drop("batch"))


def _observed(events: DataFrame, nation: DataFrame) -> DataFrame:
    return bucket_model.observations(prepare.with_delays(S.stop_events_of(events, nation)).filter("planned is not null"))


@query
def stream_bucket_stats(spark, d):
    """On top of a snapshot of the same observations."""
    nation = S.table(spark, d, "nation")
    snapshot = bucket_model.bucket_stats(_observed(S.table(spark, d, "events"), nation))
    folder = new_folder(spark, "buckets")
    # Two spans of days: the second call goes on from the first one's checkpoint and snapshot.
    for part in S.event_days(spark, d, 2):
        part.write.mode("append").parquet(f"{folder}/events")
        stats = buckets.bucket_stats_stream(_observed(S.event_stream(spark, f"{folder}/events", "*.parquet"), nation), snapshot, folder)
    return stats.select("train_class", "time_band", "n", _r("mean", "mean"), _r("m2", "m2", 3))


@query
def stream_overlay(spark, d):
    """T5: recent days as a stream over the base."""
    nation = S.table(spark, d, "nation")

    def runs(events: DataFrame) -> DataFrame:
        return history.history_runs(prepare.prepare_events(S.stop_events_of(events, nation), tie="seq"))

    base = runs(S.table(spark, d, "events"))
    laid = overlay.overlay_stream(S.event_stream(spark, d), base, lambda batch: _tiers(runs(batch))[1])
    return _run_bag(laid, "train_key", "station_name")
