"""Folds of feeds with operator state: per-stop state with timers, watermarked first plans, and plan and changes joined.

All queries name a folder that holds their checkpoint and results, so a query that is
stopped goes on from there.  State lives in RocksDB and is given up by event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lagcast.operators import condense
from lagcast.operators.condense import CHANGE_FIELDS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How far rows may lag behind the newest one, and how long a stop's state outlives its newest change.
LATENESS, KEEP_DAYS = "2 days", 3
#: Parts of the change fold's state; a checkpoint keeps the number it began with.
BUCKETS = 1024


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """State beyond the memory of executors; a streaming query reads this setting when it first starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def order_text(schema: T.StructType, name: str = "ord") -> Column:
    """The struct that orders a feed, as one text in the same order; numbers must not be negative."""
    parts = []
    for field in schema[name].dataType.fields:
        value = F.col(f"{name}.{field.name}")
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            parts.append(F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        elif isinstance(field.dataType, T.IntegralType):
            parts.append(F.lpad(value.cast("string"), 20, "0"))
        else:
            parts.append(F.concat(value.cast("string"), F.lit("\u0000")))
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def newest_values(rows: pd.DataFrame, fields: list[str]) -> pd.DataFrame:
    """Per stop the newest known value of every attribute, its order text, and the latest ``event_ms``."""
    out = rows.groupby("stop_id")[["event_ms"]].max()
    for f in fields:
        known = rows.loc[rows[f].notna(), ["stop_id", f, f"{f}_ord"]]
        last = known.sort_values(f"{f}_ord", kind="stable").drop_duplicates("stop_id", keep="last").set_index("stop_id")
        out = out.join(last)
    return out.reset_index()


def packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(held, pa.schema([(c, pa.int64() if c == "event_ms" else pa.string()) for c in held]), preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_all().to_pandas()


class ChangeFold(StatefulProcessor):
    """Newest known value of every attribute of a stop; a timer of event time gives up stops without news.

    Stops share the state of their bucket, which is read, folded and written as a whole: a
    call of the state store serves many stops.  The timer of a bucket is its earliest stop's.
    """

    def __init__(self, fields: list[str], keep_ms: int):
        self.fields, self.keep_ms = fields, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stops = handle.getValueState("stops", "packed binary")

    def keep(self, held: pd.DataFrame, watermark: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        if len(held):
            self.stops.update((packed(held),))
            self.handle.registerTimer(max(int(held["event_ms"].min()) + self.keep_ms, watermark + 1))
        else:
            self.stops.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        came = came.assign(**{f"{f}_ord": came["ord_text"] for f in self.fields})
        touched = came["stop_id"].unique()
        columns = ["stop_id", "event_ms", *[c for f in self.fields for c in (f, f"{f}_ord")]]
        parts = [came[columns]]
        if self.stops.exists():
            parts.insert(0, unpacked(bytes(self.stops.get()[0])))
        held = newest_values(pd.concat(parts, ignore_index=True), self.fields)
        self.keep(held[columns], timerValues.getCurrentWatermarkInMs())
        now = held.loc[held["stop_id"].isin(touched), ["stop_id", *self.fields]]
        yield now.astype(object).where(now.notna(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.stops.exists():
            held, watermark = unpacked(bytes(self.stops.get()[0])), timerValues.getCurrentWatermarkInMs()
            self.keep(held[held["event_ms"] + self.keep_ms > watermark], watermark)
        return iter([])

    def close(self) -> None:
        pass


def save_updates(stream: DataFrame, folder: str, once: bool = True, mode: str = "update") -> StreamingQuery:
    """Start, or go on with, a query that writes each micro-batch to ``folder/data/batch=<id>``; a replayed one overwrites itself."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def newest_updates(spark: SparkSession, folder: str, key: str = "stop_id") -> DataFrame:
    """The last row of each key over all micro-batches."""
    rows = spark.read.parquet(f"{folder}/data")
    fields = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(key, "r.*")


def timed(feed: DataFrame, event_time: Column, lateness: str = LATENESS) -> DataFrame:
    return feed.withColumn("event_time", event_time.cast("timestamp")).withWatermark("event_time", lateness)


def change_states(changes: DataFrame, event_time: Column, lateness: str = LATENESS, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Updates of the change fold, one row per stop that a micro-batch touches.

    State is a row per bucket of stops, which drops a stop ``keep_days`` after its newest change; rows later than ``lateness`` do not count.
    """
    with_rocksdb(changes.sparkSession)
    fields = [F.col(f).cast("string").alias(f) for f in CHANGE_FIELDS]
    rows = timed(changes, event_time, lateness).select(
        "stop_id", "event_time", F.unix_millis("event_time").alias("event_ms"), order_text(changes.schema).alias("ord_text"), *fields
    )
    updates = rows.withColumn("bucket", F.pmod(F.xxhash64("stop_id"), F.lit(BUCKETS))).groupBy("bucket").transformWithStateInPandas(
        ChangeFold(CHANGE_FIELDS, keep_days * 86_400_000),
        outputStructType="stop_id string, " + ", ".join(f"{f} string" for f in CHANGE_FIELDS),
        outputMode="Update",
        timeMode="EventTime",
    )
    types = {f: changes.schema[f].dataType for f in CHANGE_FIELDS}
    return updates.select("stop_id", *[F.col(f).cast(types[f]).alias(f) for f in CHANGE_FIELDS])


def first_plans(plan: DataFrame, event_time: Column, lateness: str = LATENESS) -> DataFrame:
    """First labelled plan row per stop and day of event time; the watermark ends a day's state, and rows after it are dropped and counted by the query's progress."""
    with_rocksdb(plan.sparkSession)
    fields = [c for c in plan.columns if c not in ("stop_id", "ord")]
    rows = timed(plan.filter("labelled"), event_time, lateness)
    folded = rows.groupBy(F.window("event_time", "1 day").alias("span"), "stop_id").agg(F.min_by(F.struct(*fields), "ord").alias("p"))
    return folded.select("span", "stop_id", "p.*")


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after the watermark had given up their state."""
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def stop_events(plan: DataFrame, changes: DataFrame, plan_time: Column, change_time: Column, lateness: str = LATENESS) -> DataFrame:
    """Stop events straight from both streams, final once the watermark has passed their day.

    Plan and change rows meet in one fold per stop and day of event time, so a stop costs one row of state
    and no second shuffle; a stop without changes comes out as planned, changes without a plan go.  A stop's
    plan and changes must be of one day.  The slower of both feeds moves the watermark.
    """
    with_rocksdb(plan.sparkSession)
    planned = timed(plan.filter("labelled"), plan_time, lateness).select(
        "event_time", "stop_id", F.col("ord").alias("plan_ord"), F.struct(*condense.PLAN_FIELDS).alias("p")
    )
    changed = timed(changes, change_time, lateness).select("event_time", "stop_id", "ord", *CHANGE_FIELDS)
    newest = [F.max(F.when(F.col(f).isNotNull(), F.struct("ord", f))).alias(f) for f in CHANGE_FIELDS]
    met = planned.unionByName(changed, allowMissingColumns=True).groupBy(F.window("event_time", "1 day").alias("span"), "stop_id")
    folded = met.agg(F.min_by("p", "plan_ord").alias("p"), *newest).filter("p is not null")
    return condense.joined_events(folded.select("stop_id", "p.*", *[F.col(f)[f].alias(f) for f in CHANGE_FIELDS]))
