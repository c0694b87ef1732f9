"""Preparation, histories, documents, overlay, tiers."""

import json
from datetime import date, datetime, timedelta

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lagcast import schemas
from lagcast.operators import history, history_codec, prepare
from lagcast.operators.sequence import previous_value
from lagcast.sources import tables, tiers

RUN_COLUMNS = [c.strip().split()[0] for c in schemas.RUN.strip().split(",")]


def run_row(day, tod, arr, dep=None, prev=None, cancelled=False, key="ICE_1", place="Lindau Insel", eva="8700431"):
    return (key, "ICE 1", "ICE", None, place, eva, date.fromisoformat(day), tod, arr, dep if dep is not None else arr, prev, cancelled)


def test_previous_value_equals_plain_lag(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("key"),
        (F.col("id") * 7919 % 101).alias("stop"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 5 != 0, F.col("id") * 3).alias("v"),
    ).withColumn("part", F.floor(F.col("seq") / 50))
    out = previous_value(rows, ["key"], ["stop", "part"], ["seq"], F.col("v"), "got")
    plain = F.lag("v").over(Window.partitionBy("key").orderBy("stop", "seq"))
    both = out.select("seq", "got").join(rows.select("seq", plain.alias("want")), "seq")
    assert both.count() == 3000
    assert both.filter(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def stop(ride, num, planned, delay, eva="08700431", number="1", kind="ICE", cancelled=False):
    t = datetime.fromisoformat(planned)
    moved = t + timedelta(minutes=delay) if delay is not None else None
    return ("X" + eva, eva, kind, number, None, ride, num, t, moved, None, None, cancelled)


def test_prepare_lags_over_all_stops_of_kept_trains(spark):
    events = spark.createDataFrame(
        [
            stop("r1", 1, "2026-01-01 22:00:00", 4, "0801"),
            stop("r1", 2, "2026-01-01 23:30:00", 6, "0802"),
            stop("r1", 3, "2026-01-02 00:30:00", 9, "0803"),
            stop("r1", 1, "2026-01-02 22:00:00", 1, "0801"),
            stop("r2", 1, "2026-01-01 10:00:00", 2, "0801", number="2"),
            stop("r3", 1, "2026-01-01 10:00:00", 2, "0803", number=None),
        ],
        schemas.STOP_EVENT,
    )
    got = {(r.identity, r.eva, str(r.day)): r.prev_delay for r in prepare.prepare_events(events, ["803"]).collect()}
    assert got == {
        ("ICE 1", "801", "2026-01-01"): None,
        ("ICE 1", "802", "2026-01-01"): 4,
        # after midnight, same service day
        ("ICE 1", "803", "2026-01-02"): 6,
        ("ICE 1", "801", "2026-01-02"): None,
    }
    wanted = spark.createDataFrame([("0803",)], "eva string")
    assert prepare.prepare_events(events, wanted).count() == 4


def test_encode_matches_layout(spark):
    cancelled = ("NJ_40", "NJ 40", "NJ", None, "Lindau Insel", "8700431", date(2025, 11, 9), 71, None, None, None, True)
    runs = spark.createDataFrame(
        [
            run_row("2025-11-06", 71, 12, 14, 11, key="NJ_40"),
            run_row("2025-11-06", 655, -1, -1, 0, key="NJ_40"),
            cancelled,
            run_row("2025-11-30", 940, 25, 25, 20, key="RB_7"),
            run_row("2025-12-02", 940, 0, 0, 3, key="RB_7"),
            run_row("2025-12-05", 940, 4, 4, 3, key="RB_7"),
        ],
        schemas.RUN,
    )
    got = {(r.train_key, r.block): r for r in history_codec.encode_history(runs).collect()}
    november = (2025 - 1970) * 12 + 10
    assert sorted(got) == [("NJ_40", november), ("RB_7", november), ("RB_7", november + 1)]
    first_day = (date(2025, 11, 6) - date(1970, 1, 1)).days
    a = got["NJ_40", november]
    assert (a.tod, a.days, a.t, a.a, a.d, a.p, a.c) == ([71, 655], [first_day, 0, 3], [0, 1, 0], [12, -1, None], [14, None, None], [11, 0, None], [2])
    b = got["RB_7", november + 1]
    assert (b.tod, b.days, b.t, b.a, b.d, b.c) == ([940], [first_day + 26, 3], None, [0, 4], None, None)


def test_copies_of_a_run_are_split_and_whole(spark):
    # One train holds nearly all runs, a third of them copies of one run.
    base = date(2026, 1, 1)
    rows = [run_row(str(base + timedelta(days=i % 90)), 600, i % 40, i % 40, i % 7) for i in range(400)]
    rows += [run_row("2026-01-05", 600, 1, 1, 1)] * 200
    runs = spark.createDataFrame(rows, schemas.RUN)
    blocks = history_codec.encode_history(runs, slice_runs=50)
    sizes = {r.block: r.n for r in blocks.select("block", F.size("days").alias("n")).collect()}
    assert sum(sizes.values()) == 600 and len(sizes) == 3 + 3 and max(sizes.values()) <= 205
    # More history leaves the blocks of other months as they are.
    more = history_codec.encode_history(runs.filter("month(day) > 1"), slice_runs=50)
    assert {r.block: r.n for r in more.select("block", F.size("days").alias("n")).collect()}.items() <= sizes.items()
    fields = ["day", "tod", "arr_delay", "dep_delay", "prev_delay", "cancelled"]
    back = history_codec.decode_history(blocks).select(*fields)
    assert back.exceptAll(runs.select(*fields)).count() == 0
    assert back.count() == 600


def read(spark, *documents):
    df = spark.createDataFrame(list(enumerate(documents)), "id int, document string")
    return history_codec.read_history_documents(df, ["id"]).orderBy("id", "station_name", "day", "tod").collect()


def test_reads_columnar_document(spark):
    start = (date(2024, 9, 28) - date(1970, 1, 1)).days
    harbour = {"eva": "8700431", "tod": [5, 1200], "days": [start, 3, 0, 1], "t": [1, 0, 1, 0], "a": [30, -4, None, 8], "d": [None, -2, None, None], "p": [28, None, None, 9], "c": [2]}
    pass_ = {"eva": "8700977", "tod": [700], "days": [start + 10, 40], "a": [0, 6], "p": [1, 5]}
    doc = {"v": 2, "train": "EC 191", "type": "EC", "stations": {"Lindau Insel": harbour, "Scharnitz Paß": pass_}}
    rows = read(spark, json.dumps(doc, ensure_ascii=False))
    assert [(str(r.day), r.planned_clock, r.arr_delay, r.dep_delay, r.prev_delay, r.cancelled) for r in rows] == [
        ("2024-09-28", "20:00", 30, 30, 28, False),
        ("2024-10-01", "00:05", -4, -2, None, False),
        ("2024-10-01", "20:00", None, None, None, True),
        ("2024-10-02", "00:05", 8, 8, 9, False),
        ("2024-10-08", "11:40", 0, 0, 1, False),
        ("2024-11-17", "11:40", 6, 6, 5, False),
    ]


def test_reads_row_document_and_rejects_garbage(spark):
    listed = [["2023-03-04", "07:07", -2, None, 0, 0], ["2023-03-05", "07:07", None, 9, None, 1], ["4 March", "07:07", 3, 3, 3, 0], ["2023-03-06", "07:07"]]
    doc = {"stations": {"Scharnitz Paß": {"eva": "8700977", "runs": listed}}, "train": "RB 5432", "type": "RB"}
    rows = read(spark, json.dumps(doc, ensure_ascii=False), "[]", "{\"stations\":", "{}")
    got = [(r.train, str(r.day), r.arr_delay, r.dep_delay, r.prev_delay, r.cancelled) for r in rows]
    assert got == [("RB 5432", "2023-03-04", -2, None, 0, False), ("RB 5432", "2023-03-05", None, 9, None, True)]


def test_overlay_rules(spark):
    base = spark.createDataFrame([run_row(f"2025-05-{d:02d}", 75, d) for d in (3, 4, 5)], schemas.RUN)
    recent = spark.createDataFrame([run_row("2025-05-04", 75, 44), run_row("2025-05-04", 1300, 2), run_row("2025-05-05", 75, 1, place="Scharnitz Paß")], schemas.RUN)
    got = history.overlay_recent(base, recent).collect()
    # Only the same station and planned minute of a day is replaced.
    assert sorted((r.day.day, r.station_name[:6], r.tod, r.arr_delay) for r in got) == [
        (3, "Lindau", 75, 3),
        (4, "Lindau", 75, 44),
        (4, "Lindau", 1300, 2),
        (5, "Lindau", 75, 5),
        (5, "Scharn", 75, 1),
    ]
    nothing = base.filter("false")
    assert sorted(r.day.day for r in history.overlay_recent(base, nothing).collect()) == [3, 4, 5]
    assert history.overlay_recent(nothing, recent).count() == 3


def test_train_line_keeps_last_filled(spark):
    row = list(run_row("2026-06-01", 600, 3))
    rows = []
    for day, line in ((1, "RE1"), (2, "RE2"), (3, ""), (4, None)):
        row[3], row[6] = line, date(2026, 6, day)
        rows.append(tuple(row))
    got = history.train_lines(spark.createDataFrame(rows, schemas.RUN)).collect()
    assert [(r.train_key, r.line) for r in got] == [("ICE_1", "RE2")]


def test_files_metadata_and_writers(spark, tmp_path):
    events = spark.createDataFrame([stop("r1", 1, "2026-01-01 22:00:00", 4)], schemas.STOP_EVENT)
    for name in ("data-2026-01", "data-2026-02", "data-recent-2026-03-01", "data-recent-2026-03-02"):
        pq.write_table(events.toArrow(), tmp_path / f"{name}.parquet")
    read_back = tables.with_source_file(tables.read_stop_events(spark, str(tmp_path / "data-*.parquet")))
    assert read_back.count() == 4
    runs = history.history_runs(prepare.prepare_events(read_back))
    meta = history.build_metadata(runs, read_back, ["8700431"]).collect()[0]
    assert (meta.months, meta.trains, meta.recent_from, meta.recent_through) == (["2026-01", "2026-02"], 1, "2026-03-01", "2026-03-02")
    out = str(tmp_path / "daily")
    for _ in range(2):
        tables.write_daily(events, out, F.to_date("arrival_planned_time"))
    assert spark.read.parquet(out).count() == 1
    docs = history_codec.history_documents(history_codec.encode_history(runs), history.train_lines(runs))
    history_codec.write_history(docs, str(tmp_path / "history"))
    assert spark.read.json(str(tmp_path / "history")).count() == 1


def test_station_csv(spark, tmp_path):
    (tmp_path / "stations.csv").write_text("8700431;Lindau Insel;640\n17;Halt\n31;Weiler;x\n", encoding="utf-8")
    got = [tuple(r) for r in tables.read_stations(spark, str(tmp_path / "stations.csv")).orderBy("eva").collect()]
    assert got == [("31", "Weiler", 0), ("8700431", "Lindau Insel", 640)]


def test_tiers(spark):
    def meta(generated=None, recent=None, trains=None):
        return spark.createDataFrame([(generated, recent, None, trains)], "generated string, recent_through string, x string, trains string")

    none = meta().limit(0)
    got = tiers.stale_tiers(meta("2026-07", "17"), none, none, meta("2026-07")).collect()[0]
    assert (got.base_stale, got.recent_stale) == (False, True)
    used = tiers.meta_in_use(none.drop("x", "recent_through"), meta(recent="17").select("recent_through"), meta("2026-01", trains="9").select("generated", "trains")).collect()
    assert [tuple(r) for r in used] == [("2026-01", "17", 9, True)]
    assert tiers.meta_in_use(none.select("generated", "trains"), none.select("recent_through"), none.select("generated", "trains")).count() == 0
