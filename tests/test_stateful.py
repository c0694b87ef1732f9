"""Streams with operator state: resumed, late and given up; snapshots found again; only changed days rebuilt."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lagcast.functions import times
from lagcast.operators import bucket_model, condense, history, prepare
from lagcast.session import generations
from lagcast.sources import derived, incremental, tables
from lagcast.streaming import buckets, stateful


def day_files(spark, folder, days, per_day=40, start=0):
    """One file of events per day."""
    kinds = list(derived.LINES)
    for day in days:
        rows = spark.range(per_day).select(
            (F.col("id") + day * 1000 + start).alias("event_id"),
            F.expr(f"timestamp_ntz'2024-01-01 05:00:00' + make_dt_interval({day}, cast(id % 13 as int), cast(id * 7 % 60 as int), 0)").alias("ts"),
            (F.col("id") % 5).alias("user_id"),
            F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
            (F.col("id") * 3 % 90).cast("double").alias("value"),
            F.concat(F.lit('{"k": '), (F.col("id") * 11 % 83).cast("string"), F.lit("}")).alias("props"),
        )
        pq.write_table(rows.toArrow(), f"{folder}/day-{day:02d}-{start}.parquet")


@pytest.fixture(scope="module")
def nation(spark):
    return spark.createDataFrame([(i, f"NATION_{i}") for i in range(25)], "n_nationkey int, n_name string")


def stream(spark, folder):
    return derived.event_stream(spark, str(folder), "*.parquet")


def same(a, b):
    b = b.select(a.columns)
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_change_states_resume_and_equal_the_fold(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for days in ([0, 1], [1, 2], [6]):
        day_files(spark, folder, days, start=100 * days[0])
        rows = stateful.change_states(derived.change_feed(stream(spark, folder)), F.col("ord.ts"))
        query = stateful.save_updates(rows, str(tmp_path / "out"))
        query.awaitTermination()
    same(stateful.newest_updates(spark, str(tmp_path / "out")), condense.fold_changes(derived.change_feed(spark.read.parquet(str(folder)))))
    # Days 0 to 2 were given up by their timers once day 6 had come; the state holds what is left.
    left = sum(op.numRowsTotal for op in query.lastProgress.stateOperators)
    assert left < spark.read.parquet(str(tmp_path / "out/data")).select("stop_id").distinct().count() * 2


def test_first_plans_drop_and_count_late_rows(spark, tmp_path, nation):
    folder = tmp_path / "in"
    folder.mkdir()
    plans = lambda: stateful.first_plans(derived.plan_feed(stream(spark, folder), nation), F.col("ord.ts")).drop("span")
    day_files(spark, folder, [0, 1, 8])
    expected = condense.first_plan(derived.plan_feed(spark.read.parquet(str(folder)), nation))
    stateful.save_updates(plans(), str(tmp_path / "out")).awaitTermination()
    day_files(spark, folder, [0], start=500)
    query = stateful.save_updates(plans(), str(tmp_path / "out"))
    query.awaitTermination()
    assert stateful.late_rows(query) > 0
    same(stateful.newest_updates(spark, str(tmp_path / "out")), expected)


def test_joined_streams_equal_the_daily_fold(spark, tmp_path, nation):
    folder = tmp_path / "in"
    folder.mkdir()
    day_files(spark, folder, [0, 1, 3])
    events = spark.read.parquet(str(folder))
    expected = condense.condense(condense.first_plan(derived.plan_feed(events, nation)), condense.fold_changes(derived.change_feed(events)))
    for days in (0, 10):
        if days:
            pq.write_table(derived.closing_events(events, days).toArrow(), f"{folder}/closing-{days}.parquet")
        feed = stream(spark, folder)
        joined = stateful.stop_events(derived.plan_feed(feed, nation), derived.change_feed(feed), F.col("ord.ts"), F.col("ord.ts"))
        stateful.save_updates(joined, str(tmp_path / "out"), mode="append").awaitTermination()
    same(spark.read.parquet(str(tmp_path / "out/data")).drop("batch"), expected)


def test_snapshots_are_found_after_a_restart(spark, tmp_path, nation):
    folder = tmp_path / "in"
    folder.mkdir()

    def observed(events):
        return bucket_model.observations(prepare.with_delays(derived.stop_events_of(events, nation)).filter("planned is not null"))

    for days in ([0], [1, 2], []):
        day_files(spark, folder, days)
        out = buckets.bucket_stats_stream(observed(stream(spark, folder)), folder=str(tmp_path / "out"))
    assert len(generations(spark, f"{tmp_path}/out/snapshots")) == 2
    batch = {(r.train_class, r.time_band): r for r in bucket_model.bucket_stats(observed(spark.read.parquet(str(folder)))).collect()}
    for r in out.collect():
        assert r.n == batch.pop((r.train_class, r.time_band)).n
    assert not batch


def test_rebuild_reads_only_changed_days(spark, tmp_path, nation):
    (tmp_path / "in").mkdir()
    day_files(spark, tmp_path / "in", range(5))
    events = derived.stop_events_of(spark.read.parquet(str(tmp_path / "in")), nation)
    daily, store, day = str(tmp_path / "daily"), str(tmp_path / "store"), incremental.event_service_day()
    tables.write_daily(events, daily, day)
    assert len(incremental.rebuild_runs(spark, daily, store, tie="seq")) >= 5
    assert incremental.rebuild_runs(spark, daily, store, tie="seq") == []
    changed = events.filter(day == "2024-01-03").withColumn("arrival_change_time", F.expr("arrival_change_time + interval 3 minutes"))
    tables.write_daily(changed, daily, day)
    assert incremental.rebuild_runs(spark, daily, store, tie="seq") == ["2024-01-03"]
    whole = history.history_runs(prepare.prepare_events(spark.read.parquet(daily), tie="seq"))
    same(incremental.stored_runs(spark, store), whole)
    assert whole.select(times.service_day(times.at_minute(F.col("day"), F.col("tod"))).alias("d")).distinct().count() >= 5
