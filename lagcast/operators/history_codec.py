"""Columnar history blocks and history documents.

A block lists the runs of one train at one station in one calendar month: sorted
planned times once, delta-coded days, sparse departures, indices of cancelled runs.
The block of a run depends on the run alone, so blocks do not change when history grows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast import schemas
from lagcast.functions.times import clock, parse_clock

RUN_FIELDS = ["day", "tod", "arr_delay", "dep_delay", "prev_delay", "cancelled"]
STATION_KEYS = ["train_key", "station_name"]


def with_block(runs: DataFrame, slice_runs: int = P.SLICE_RUNS) -> DataFrame:
    """Block number of every run: its month, counted from 1970.

    Equal runs are counted first; copies beyond ``slice_runs`` continue in further
    blocks of the month, so that copies of one run cannot pile up in one block.
    """
    counted = runs.groupBy(*STATION_KEYS, *RUN_FIELDS).agg(F.count("*").alias("copies"))
    slices = F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / slice_runs).cast("int"))
    dealt = counted.withColumn("slice", F.explode(slices)).withColumn(
        "copies", F.least(F.lit(slice_runs), F.col("copies") - F.col("slice") * slice_runs).cast("int")
    )
    evas = runs.groupBy(*STATION_KEYS).agg(F.min("eva").alias("eva"))
    month = (F.year("day") - 1970) * 12 + F.month("day") - 1
    return dealt.join(evas, STATION_KEYS).withColumn("block", (month + F.col("slice") * P.SLICE_STEP).cast("int"))


def encode_history(runs: DataFrame, slice_runs: int = P.SLICE_RUNS) -> DataFrame:
    """Run table to columnar blocks."""
    blocks = (
        with_block(runs, slice_runs)
        .groupBy(*STATION_KEYS, "block")
        .agg(F.min("eva").alias("eva"), F.sort_array(F.collect_list(F.struct(*RUN_FIELDS, "copies"))).alias("kept"))
        .withColumn(
            "r",
            F.flatten(F.transform("kept", lambda x: F.array_repeat(x, x["copies"]))),
        )
    )
    r = F.col("r")

    def each(fn) -> Column:
        return F.transform(r, fn)

    day = F.unix_date
    tods = F.array_sort(F.array_distinct(each(lambda x: x["tod"])))
    days = each(
        lambda x, i: F.when(i == 0, day(x["day"])).otherwise(
            day(x["day"]) - day(F.get(r, F.greatest(i - 1, F.lit(0)))["day"])
        )
    )
    departures = each(lambda x: F.when(~x["dep_delay"].eqNullSafe(x["arr_delay"]), x["dep_delay"]))
    cancelled = F.array_compact(each(lambda x, i: F.when(x["cancelled"], i)))
    return blocks.withColumn("tod", tods).select(
        *STATION_KEYS,
        "block",
        "eva",
        "tod",
        days.alias("days"),
        F.when(F.size("tod") > 1, each(lambda x: (F.array_position(F.col("tod"), x["tod"]) - 1).cast("int"))).alias("t"),
        each(lambda x: x["arr_delay"]).alias("a"),
        F.when(F.exists(departures, lambda d: d.isNotNull()), departures).alias("d"),
        each(lambda x: x["prev_delay"]).alias("p"),
        F.when(F.size(cancelled) > 0, cancelled).alias("c"),
    )


def decode_history(blocks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Columnar blocks to runs; a missing departure means the arrival delay."""
    keys = keys or [*STATION_KEYS, "block"]
    so_far = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.select(*blocks.columns, F.posexplode("days").alias("i", "delta"))
    arr = F.get("a", F.col("i"))
    tod_at = F.coalesce(F.get("t", F.col("i")), F.lit(0))
    return rows.select(
        *keys,
        "eva",
        F.date_from_unix_date(F.sum(F.coalesce("delta", F.lit(0))).over(so_far).cast("int")).alias("day"),
        F.coalesce(F.get("tod", tod_at), F.lit(0)).alias("tod"),
        arr.alias("arr_delay"),
        F.coalesce(F.get("d", F.col("i")), arr).alias("dep_delay"),
        F.get("p", F.col("i")).alias("prev_delay"),
        F.coalesce(F.array_contains("c", F.col("i")), F.lit(False)).alias("cancelled"),
    )


def history_documents(blocks: DataFrame, trains: DataFrame) -> DataFrame:
    """One JSON document per train and block number (``trains`` from ``train_lines``).

    The map holds one entry per station, so its size is bounded by the stations.
    """
    fields = ["eva", "tod", "days", "t", "a", "d", "p", "c"]
    by_train = blocks.groupBy("train_key", "block").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("station_name", F.struct(*fields).alias("station"))))
        ).alias("stations")
    )
    document = F.to_json(F.struct(F.lit(2).alias("v"), "train", F.col("train_type").alias("type"), "line", "stations"))
    return by_train.join(trains, "train_key").select("train_key", "train_type", "block", document.alias("document"))


def write_history(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").partitionBy("train_type").option("compression", "gzip").json(path)


def read_history_documents(documents: DataFrame, keys: list[str]) -> DataFrame:
    """History documents of either layout to runs; garbage yields no row.

    ``keys`` identify a document; its text is in ``document``.
    """
    stations = (
        documents.withColumn("doc", F.from_json("document", schemas.HISTORY_DOCUMENT))
        .filter(F.col("doc.stations").isNotNull())
        .select(
            *keys,
            F.coalesce("doc.train", F.lit("?")).alias("train"),
            F.coalesce("doc.type", F.lit("?")).alias("train_type"),
            F.explode("doc.stations").alias("station_name", "s"),
        )
    )
    keys = [*keys, "train", "train_type", "station_name"]
    columnar = decode_history(stations.filter("s.days is not null").select(*keys, "s.*"), keys)
    run = F.col("run")
    rows = (
        stations.filter("s.days is null")
        .select(*keys, F.col("s.eva").alias("eva"), F.explode("s.runs").alias("run"))
        .filter(F.size(run) >= 6)
        .select(
            *keys,
            "eva",
            run[0].try_cast("date").alias("day"),
            parse_clock(run[1]).alias("tod"),
            run[2].try_cast("int").alias("arr_delay"),
            run[3].try_cast("int").alias("dep_delay"),
            run[4].try_cast("int").alias("prev_delay"),
            F.coalesce(run[5].try_cast("int") == 1, F.lit(False)).alias("cancelled"),
        )
        .filter(F.col("day").isNotNull())
    )
    return columnar.unionByName(rows).withColumn("planned_clock", clock(F.col("tod")))
