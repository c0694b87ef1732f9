"""Streams over several micro-batches against their batch results."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lagcast.operators import bucket_model, condense, prepare
from lagcast.sources import derived
from lagcast.streaming import buckets, feeds, partials


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events in five files that do not follow the order of time."""
    path = tmp_path_factory.mktemp("events")
    kinds = list(derived.LINES)
    rows = spark.range(600).select(
        F.col("id").alias("event_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id % 97 * 31 as int), 0)").alias("ts"),
        (F.col("id") % 5).alias("user_id"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        (F.col("id") % 90).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), (F.col("id") % 83).cast("string"), F.lit("}")).alias("props"),
    )
    for i in range(5):
        pq.write_table(rows.filter(F.floor(F.col("event_id") * 7 / 3) % 5 == i).toArrow(), path / f"part-{i}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def nation(spark):
    return spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string")


def small_batches(spark, folder):
    return spark.readStream.schema(derived.EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)


def same(a, b):
    b = b.select(a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_change_fold_over_batches(spark, folder):
    events = spark.read.parquet(folder)
    out = feeds.fold_change_stream(derived.change_feed(small_batches(spark, folder)))
    same(out, condense.fold_changes(derived.change_feed(events)))


def test_first_plan_over_batches(spark, folder, nation):
    events = spark.read.parquet(folder)
    out = feeds.first_plan_stream(derived.plan_feed(small_batches(spark, folder), nation))
    same(out, condense.first_plan(derived.plan_feed(events, nation)))


def test_live_board_over_batches(spark, folder, nation):
    events, live = spark.read.parquet(folder), small_batches(spark, folder)
    out = feeds.live_board_stream(derived.plan_feed(live, nation), derived.change_feed(live))
    same(out, condense.live_board(derived.plan_feed(events, nation), derived.change_feed(events)))


def test_bucket_stats_over_batches(spark, folder, nation):
    def observed(events):
        rows = prepare.with_delays(derived.stop_events_of(events, nation))
        return bucket_model.observations(rows.filter("planned is not null"))

    batch = {(r.train_class, r.time_band): r for r in bucket_model.bucket_stats(observed(spark.read.parquet(folder))).collect()}
    out = {(r.train_class, r.time_band): r for r in buckets.bucket_stats_stream(observed(small_batches(spark, folder))).collect()}
    assert out.keys() == batch.keys()
    for key, row in out.items():
        assert row.n == batch[key].n and row.m2 == pytest.approx(batch[key].m2) and row["mean"] == pytest.approx(batch[key]["mean"])


def test_compaction_keeps_the_fold(spark, folder, tmp_path):
    changes = derived.change_feed(small_batches(spark, folder))
    query = partials.write_partials(changes, feeds.partial_changes, str(tmp_path / "data"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "data")).select("batch").distinct().count() == 5
    partials.compact(spark, str(tmp_path / "data"), feeds.merged_changes, str(tmp_path / "compact"))
    same(spark.read.parquet(str(tmp_path / "compact")), condense.fold_changes(derived.change_feed(spark.read.parquet(folder))))
