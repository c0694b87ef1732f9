"""Expressions on literal cases."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagcast.functions import calendar, delays, text, times
from lagcast.functions.student_t import standard_cdf, standard_quantile, t_cdf, t_quantile


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict() for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_keys_mirror_identities(spark):
    rows = values(spark, [("ICE 512",), (" RB 86 ",), ("S 31648",)], "t string", k=text.train_key(F.col("t")))
    assert [r["k"] for r in rows] == ["ICE_512", "RB_86", "S_31648"]


def test_identity_is_null_if_a_part_is(spark):
    rows = values(spark, [("ICE", None), (None, "5"), ("ICE", "5")], "t string, n string", i=text.train_identity(F.col("t"), F.col("n")))
    assert [r["i"] for r in rows] == [None, None, "ICE 5"]


def test_lookup_keys(spark):
    cases = [("RE", "123", "RE9"), ("RE", "", "9"), ("RE", "9", "9"), ("S", " ", None)]
    rows = values(spark, cases, "c string, n string, l string", k=text.lookup_keys(F.col("c"), F.col("n"), F.col("l")))
    assert [r["k"] for r in rows] == [["RE_123", "RE9"], ["RE_9"], ["RE_9"], []]


def test_labels(spark):
    cases = [("RB", "57177", "RB86"), ("S", "1", "3"), ("ICE", "512", None)]
    rows = values(spark, cases, "c string, n string, l string", x=text.label(F.col("c"), F.col("n"), F.col("l")))
    assert [r["x"] for r in rows] == ["RB86", "S 3", "ICE 512"]


def test_normal_names(spark):
    cases = [("München-Pasing",), ("Halle (Saale)  Hbf",), ("Gießen",)]
    rows = values(spark, cases, "n string", x=text.normal_name(F.col("n")))
    assert [r["x"] for r in rows] == ["munchen pasing", "halle saale hbf", "giessen"]


def test_route_matching_directions(spark):
    cases = [(["Ulm Hbf"], "ulm"), (["Ulm"], "Ulm Hbf"), (["Bonn"], "Ulm")]
    rows = values(
        spark,
        cases,
        "p array<string>, d string",
        both=text.route_reaches(F.col("p"), F.col("d"), True),
        one=text.route_reaches(F.col("p"), F.col("d"), False),
    )
    assert [(r["both"], r["one"]) for r in rows] == [(True, True), (True, False), (False, False)]


def test_compact_times(spark):
    cases = [("2607161904",), ("garbage",), ("",), (None,), ("2613401904",)]
    rows = values(spark, cases, "s string", t=times.parse_compact(F.col("s")))
    assert [r["t"] for r in rows] == [datetime(2026, 7, 16, 19, 4), None, None, None, None]


def test_live_minutes_use_instants(spark):
    # The clock jumps from 02:00 to 03:00 on 2026-03-29 in Berlin.
    cases = [(datetime(2026, 3, 29, 1, 50), datetime(2026, 3, 29, 3, 5)), (datetime(2026, 7, 16, 19, 4), datetime(2026, 7, 16, 19, 20))]
    rows = values(spark, cases, "p timestamp_ntz, c timestamp_ntz", m=times.live_minutes(F.col("c"), F.col("p")))
    assert [r["m"] for r in rows] == [15.0, 16.0]


def test_whole_minutes_cut_toward_zero(spark):
    cases = [(datetime(2026, 1, 1, 10, 0), datetime(2026, 1, 1, 9, 55, 30)), (datetime(2026, 1, 1, 10, 0), datetime(2026, 1, 1, 10, 1, 59))]
    rows = values(spark, cases, "p timestamp_ntz, c timestamp_ntz", m=times.whole_minutes(F.col("c"), F.col("p")))
    assert [r["m"] for r in rows] == [-4, 1]


def test_service_day_and_next_at(spark):
    cases = [(datetime(2026, 1, 2, 1, 30), 60), (datetime(2026, 1, 2, 23, 0), 30), (datetime(2026, 1, 2, 10, 0), 600)]
    rows = values(
        spark, cases, "t timestamp_ntz, m int", s=times.service_day(F.col("t")), n=times.next_at(F.col("t"), F.col("m"))
    )
    assert [r["s"] for r in rows] == [date(2026, 1, 1), date(2026, 1, 2), date(2026, 1, 2)]
    assert [r["n"] for r in rows] == [datetime(2026, 1, 3, 1, 0), datetime(2026, 1, 3, 0, 30), datetime(2026, 1, 2, 10, 0)]


def test_clock_text(spark):
    rows = values(spark, [("06:23",), ("7",), ("a:b",), ("1:2:3",)], "s string", m=times.parse_clock(F.col("s")))
    assert [r["m"] for r in rows] == [383, None, None, None]
    assert values(spark, [(1079,)], "m int", c=times.clock(F.col("m")))[0]["c"] == "17:59"


def test_tick_step(spark):
    rows = values(spark, [(4,), (7,), (41,), (200,)], "r int", s=times.tick_step(F.col("r")))
    assert [r["s"] for r in rows] == [1, 2, 15, 60]


def test_clamp_keeps_null(spark):
    rows = values(spark, [(None,), (-99,), (999,), (5,)], "d int", c=delays.clamp(F.col("d")))
    assert [r["c"] for r in rows] == [None, -30, 360, 5]


def test_tod_gap_is_circular(spark):
    rows = values(spark, [(1435, 5), (10, 40), (None, 3)], "a int, b int", g=delays.tod_gap(F.col("a"), F.col("b")))
    assert [r["g"] for r in rows] == [10, 30, None]


def test_classes_and_ticket(spark):
    covered = ["RE", "RB", "IRE", "S", "MEX", "BRB", "ALX", "ag", "ME", "HLB", "re"]
    not_covered = ["ICE", "IC", "EC", "ECE", "RJ", "RJX", "NJ", "EN", "FLX", "TGV", "D", "WB", "ice"]
    rows = values(spark, [(c,) for c in covered + not_covered], "c string", t=delays.ticket_covers(F.col("c")))
    assert [r["t"] for r in rows] == [True] * len(covered) + [False] * len(not_covered)
    rows = values(
        spark, [("S",), ("BRB",), ("7",), ("",), ("WB",)], "c string", k=delays.train_class(F.col("c")), b=delays.product_bucket(F.col("c"))
    )
    assert [r["k"] for r in rows] == ["SBAHN", "REGIONAL", "OTHER", "OTHER", "LONG_DISTANCE"]
    assert rows[-1]["b"] == "regional"


def test_weights(spark):
    cases = [(date(2026, 6, 1), date(2026, 7, 1)), (date(2026, 6, 3), date(2026, 7, 1)), (date(2026, 7, 5), date(2026, 7, 1))]
    rows = values(spark, cases, "d date, a date", w=delays.run_weight(F.col("d"), F.col("a")))
    assert rows[0]["w"] == pytest.approx(0.5)
    assert rows[1]["w"] == pytest.approx(2 * 0.5 ** (28 / 30))
    assert rows[2]["w"] == pytest.approx(1.0)


def test_easter_and_holidays(spark):
    rows = values(spark, [(2025,), (2026,), (2027,)], "y int", e=calendar.easter_sunday(F.col("y")))
    assert [r["e"] for r in rows] == [date(2025, 4, 20), date(2026, 4, 5), date(2027, 3, 28)]
    yes = "2026-01-01 2026-04-03 2026-04-06 2026-05-01 2026-05-14 2026-05-25 2026-10-03 2026-12-25 2026-12-26".split()
    no = "2026-07-24 2026-06-04".split()
    rows = values(spark, [(date.fromisoformat(d),) for d in yes + no], "d date", h=calendar.is_holiday(F.col("d")))
    assert [r["h"] for r in rows] == [True] * 9 + [False] * 2
    rows = values(spark, [(date(2026, 6, 4),), (date(2026, 1, 6),), (date(2026, 8, 15),)], "d date", h=calendar.is_holiday(F.col("d"), True))
    assert [r["h"] for r in rows] == [True, True, False]


def test_next_timetable_change(spark):
    cases = [(date(2026, 7, 19),), (date(2026, 6, 1),), (date(2026, 12, 13),)]
    rows = values(spark, cases, "d date", c=calendar.next_timetable_change(F.col("d")))
    assert [r["c"] for r in rows] == [date(2026, 12, 13), date(2026, 6, 14), date(2027, 6, 13)]


def test_student_t_known_values():
    assert standard_cdf(np.array([0.0, 1.0, -1.0]), np.ones(3)) == pytest.approx([0.5, 0.75, 0.25], abs=1e-12)
    assert standard_cdf(np.array([1.0, 2.0]), np.full(2, 1e6)) == pytest.approx([0.8413447, 0.9772499], abs=1e-4)
    q = standard_quantile(np.array([0.95, 0.05, 0.5]), np.full(3, 5.0))
    assert q == pytest.approx([2.015048, -2.015048, 0.0], abs=1e-6)
    p = np.array([0.001, 0.05, 0.25, 0.5, 0.75, 0.9, 0.99, 0.9999])
    for df in (1.0, 2.0, 6.0, 7.0, 59.0, 61.0, 500.0, 1e5):
        assert standard_cdf(standard_quantile(p, np.full(8, df)), np.full(8, df)) == pytest.approx(p, abs=1e-9)


def test_student_t_matches_finite_series():
    # For even df the distribution function is a finite sum.
    def series(t, df):
        c2 = 1 / (1 + t * t / df)
        term, total = 1.0, 1.0
        for j in range(1, df // 2):
            term *= (2 * j - 1) / (2 * j) * c2
            total += term
        return 0.5 + 0.5 * (t / math.sqrt(df + t * t)) * total

    for df in (2, 4, 6, 20, 60, 62, 300):
        for t in (-3.0, -0.2, 0.7, 2.5, 9.0):
            assert standard_cdf(np.array([t]), np.array([float(df)]))[0] == pytest.approx(series(t, df), abs=1e-11)


def test_student_t_columns(spark):
    df = spark.createDataFrame([(8.0, 3.0, 2.0), (None, None, None)], "df double, loc double, scale double")
    p = [F.col(c) for c in ("df", "loc", "scale")]
    rows = df.select(t_cdf(F.lit(3.0), *p).alias("c"), t_quantile(F.lit(0.9), *p).alias("q")).collect()
    assert rows[0].c == pytest.approx(0.5)
    assert rows[0].q == pytest.approx(3 + 2 * 1.396815, abs=1e-5)
    assert rows[1].c is None and rows[1].q is None
