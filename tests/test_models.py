"""Distributions, forecasts, transfers, boards, feeds, backtest."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast import schemas
from lagcast.operators import boards, bucket_model, condense, empirical, forecast, history
from lagcast.operators import distribution as D
from lagcast.operators import stations as stations_op
from lagcast.operators.transfer import Candidates, headline_catch, propagate_transfer
from lagcast.plans import backtest, journeys
from lagcast.sources import raw_log

TODAY = date(2026, 7, 1)


def runs_of(spark, rows, key="ICE_512", place="Augsburg Hbf", eva="8000013"):
    """rows: (days ago, tod, arr, dep, prev, cancelled)"""
    data = [
        (key, key.replace("_", " "), key.split("_")[0], None, place, eva, TODAY - timedelta(days=ago), tod, arr, dep, prev, c)
        for ago, tod, arr, dep, prev, c in rows
    ]
    return spark.createDataFrame(data, schemas.RUN)


def ask(spark, tod=600, live=None, query_id="q"):
    return spark.createDataFrame(
        [(query_id, "ICE_512", "Augsburg Hbf", tod, TODAY, live)],
        "query_id string, train_key string, station_name string, tod int, as_of date, live double",
    )


def test_quantiles_follow_the_runs(spark):
    runs = runs_of(spark, [(1, 600, i % 10, None, None, False) for i in range(100)])
    points = empirical.empirical_points(runs, ask(spark))
    got = D.card(points, ["query_id"]).collect()[0]
    assert (got["median"], got.q10, got.q90) == (4.0, 0.0, 8.0)
    assert got.p_within5 == pytest.approx(0.6)


def test_time_of_day_window_and_no_match(spark):
    runs = runs_of(spark, [(1, 600, 5, None, None, False), (1, 621, 50, None, None, False), (1, 580, 6, None, None, False)])
    points = {r.value for r in empirical.empirical_points(runs, ask(spark)).collect()}
    assert points == {5.0, 6.0}
    assert empirical.empirical_points(runs, ask(spark, 1000)).count() == 0
    assert empirical.cancel_rates(runs, ask(spark, 1000)).count() == 0


def test_midnight_window(spark):
    runs = runs_of(spark, [(1, 1435, 5, None, None, False)])
    assert empirical.empirical_points(runs, ask(spark, 5)).count() == 1


def test_cancel_rate(spark):
    runs = runs_of(spark, [(i + 1, 600, 3, None, None, False) for i in range(30)] + [(i + 1, 600, None, None, None, True) for i in range(10)])
    assert empirical.cancel_rates(runs, ask(spark)).collect()[0].cancel_rate == pytest.approx(0.25)


def test_delta_anchors_at_the_live_delay(spark):
    # Every run gained one minute on the last hop.
    runs = runs_of(spark, [(i + 1, 600, i % 7 + 1, None, i % 7, False) for i in range(40)])
    points = empirical.empirical_points(runs, ask(spark, live=90.0)).collect()
    assert {p.value for p in points} == {91.0}
    assert points[0].on_live and points[0]["sample"] == 40


def test_delta_needs_eight_known_runs(spark):
    rows = [(i + 1, 600, 4, None, 3 if i < 7 else None, False) for i in range(40)]
    points = empirical.empirical_points(runs_of(spark, rows), ask(spark, live=20.0)).collect()
    assert {p.value for p in points} == {4.0} and not points[0].on_live


def brute_points(rows, live):
    """Weights per value straight from the definition."""
    out = {}
    usable = [r for r in rows if not r[5] and (r[2] if r[2] is not None else r[3]) is not None and abs(r[1] - 600) <= 20]
    known = [r for r in usable if r[4] is not None]
    use = live is not None and len(known) >= 8
    for ago, _, arr, dep, prev, _ in known if use else usable:
        final = arr if arr is not None else dep
        w = 0.5 ** (ago / 30) * (2 if (TODAY - timedelta(days=ago)).weekday() == TODAY.weekday() else 1)
        value = float(final)
        if use:
            z = (prev - live) / max(3.0, 0.3 * abs(live))
            w *= 0.15 + 2.718281828459045 ** (-z * z / 2)
            value = live + final - prev
        out[value] = out.get(value, 0) + w
    return out


@pytest.mark.parametrize("live", [None, 7.0, 40.0])
def test_points_match_brute_force(spark, live):
    rng = random.Random(3)

    def maybe(lo, hi):
        return None if rng.random() < 0.2 else rng.randint(lo, hi)

    rows = [(rng.randint(1, 90), rng.choice([575, 585, 600, 612, 620]), maybe(-5, 30), maybe(-5, 30), maybe(-5, 30), rng.random() < 0.1) for _ in range(400)]
    got = {r.value: r.weight for r in empirical.empirical_points(runs_of(spark, rows), ask(spark, live=live)).collect()}
    want = brute_points(rows, live)
    assert got.keys() == want.keys()
    assert all(got[v] == pytest.approx(want[v]) for v in want)


def test_bucket_stats_and_posterior(spark):
    seen = spark.createDataFrame([("REGIONAL", "MIDDAY", float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "train_class string, time_band string, delay double")
    stats = bucket_model.bucket_stats(seen)
    row = stats.collect()[0]
    assert (row.n, row["mean"], row.m2) == (8, pytest.approx(5), pytest.approx(32))
    wanted = spark.createDataFrame([("LONG_DISTANCE", "NIGHT", None), ("LONG_DISTANCE", "MIDDAY", 23.0), ("REGIONAL", "MIDDAY", None)], "train_class string, time_band string, live double")
    got = {(r.train_class, r.time_band): r for r in bucket_model.anchor_live(bucket_model.posterior_predictive(wanted, stats)).collect()}
    prior = got["LONG_DISTANCE", "NIGHT"]
    assert (prior.loc, prior.df) == (4.0, 6.0)
    assert got["LONG_DISTANCE", "MIDDAY"].loc == 23.0
    assert got["REGIONAL", "MIDDAY"].loc == pytest.approx((4 * 1.5 + 8 * 5) / 12)


def test_forecast_falls_back_and_matches_names(spark):
    runs = runs_of(spark, [(i + 1, 600, 3, None, 2, False) for i in range(30)])
    base = ("ICE", "512", None, "x", "augsburg hbf", datetime(2026, 7, 2, 10, 0), None, TODAY)
    queries = spark.createDataFrame(
        [("name", *base), ("line", "ICE", "", "512", *base[3:]), ("unknown", "ICE", "9", *base[2:]), ("elsewhere", *base[:4], "Ulm", *base[5:])],
        "query_id string, category string, number string, line string, eva string, place string, planned timestamp_ntz, live double, as_of date",
    )
    made = forecast.forecast(queries, runs)
    got = {r.query_id: r for r in forecast.forecast_cards(made).collect()}
    assert got["name"].source == "EMPIRICAL" and got["name"]["median"] == 3.0 and got["name"].run_count == 30
    assert got["line"].source == "EMPIRICAL"
    for other in ("unknown", "elsewhere"):
        assert got[other].source == "PRIOR" and got[other].cancel_probability is None
        assert got[other]["median"] == pytest.approx(4.0)
    mass = {r.query_id: r.m for r in forecast.equal_mass_samples(made).groupBy("query_id").agg(F.sum("mass").alias("m")).collect()}
    assert all(m == pytest.approx(1.0) for m in mass.values()) and len(mass) == 4


def test_equal_mass_samples_match_levels(spark):
    rng = random.Random(5)
    points = [("q", float(v), rng.random()) for v in range(37)]
    summary = spark.createDataFrame([], "query_id string, source string, df double, loc double, scale double")
    made = forecast.Forecasts(summary, spark.createDataFrame(points, "query_id string, value double, weight double"))
    got = {r.delay: round(r.mass * 80) for r in forecast.equal_mass_samples(made).collect()}
    total, want = sum(w for *_, w in points), {}
    for i in range(80):
        acc = 0.0
        for _, v, w in points:
            acc += w
            if acc >= (i + 0.5) / 80 * total:
                want[v] = want.get(v, 0) + 1
                break
    assert got == want


def test_crps_and_shares_match_pairs(spark):
    rng = random.Random(7)
    data = [(k, float(rng.randint(-5, 25)), rng.random()) for k in range(20) for _ in range(15)]
    df = spark.createDataFrame(data, "k int, value double, weight double")
    got = {r.k: r.crps for r in D.crps_terms(D.summed(df, ["k"]), ["k"], F.lit(4.0)).collect()}
    for k in range(20):
        pts = [(v, w) for kk, v, w in data if kk == k]
        t = sum(w for _, w in pts)
        want = sum(w * abs(v - 4) for v, w in pts) / t - sum(a * b * abs(v - u) for v, a in pts for u, b in pts) / (2 * t * t)
        assert got[k] == pytest.approx(want) and got[k] > -1e-12


def test_histogram_covers_the_middle(spark):
    df = spark.createDataFrame([("q", float(v), 1.0) for v in range(-3, 60)], "query_id string, value double, weight double")
    bins = D.histogram(df, ["query_id"]).orderBy("bin").collect()
    assert bins[0].bin == -4 and bins[0].width == 2
    assert 0.95 <= sum(b.share for b in bins) <= 1.0


# ---------------------------------------------------------------- transfers

T0 = datetime(2026, 7, 2, 12, 0)


def random_transfer(rng):
    """points (delay, weight) of the feeder; candidates (id, minutes after T0, ride, live, cancelled, rate); runs (id, dep, arr, weight)."""
    points = [(float(v), rng.choice([1.0, 2.5, 4.0])) for v in rng.sample(range(-3, 70), rng.randrange(1, 7))]
    candidates, runs = [], []
    for c in range(rng.randrange(1, 6)):
        live = rng.choice([None, None, None, 0.0, 13.0, 41.0])
        candidates.append((f"c{c}", rng.randrange(0, 95), rng.choice([17, 26, 51]), live, rng.random() < 0.15, rng.choice([0.0, 0.0, 0.3])))
        runs += [(f"c{c}", rng.randrange(0, 30), rng.randrange(-4, 35), rng.choice([1.0, 0.25])) for _ in range(rng.choice([0, 1, 4, 9]))]
    return points, candidates, runs, rng.choice([2, 5, 11])


def passenger(samples, candidates, runs, minutes):
    """One passenger per sample takes the first train that is still there: board chances, points, miss, headline; None if nobody boards."""
    own = {c: [r[1:] for r in runs if r[0] == c] for c, *_ in candidates}
    listed = sorted((m, c, ride, live, gone, rate) for c, m, ride, live, gone, rate in candidates if gone or live is not None or own[c])
    running = [x for x in listed if not x[4]]
    if not running:
        return None
    reference = running[0][0] + running[0][2]
    board, points, missed = {x[1]: 0.0 for x in listed}, {}, 0.0
    for delay, mass in samples:
        left = mass
        for m, c, ride, live, gone, rate in listed:
            ready, base, total = delay + minutes - m, m + ride - reference, sum(w for *_, w in own[c])
            if gone:
                continue
            if live is not None:
                p = float(live >= ready)
                ends = [(base + live + a - d, w / total) for d, a, w in own[c]] or [(base + live, 1.0)]
            else:
                p = (1 - rate) * sum(w for d, _, w in own[c] if d >= ready) / total
                ends = [(base + a, (1 - rate) * w / total) for d, a, w in own[c] if d >= ready]
            for value, w in ends if p else ():
                points[value] = points.get(value, 0.0) + left * w
            board[c] += left * p
            left *= 1 - p
        missed += left
    points = {v: w for v, w in points.items() if w > 0}
    later = [x for x in running if x[0] >= 0] or running
    return (board, points, missed, board[later[0][1]], reference) if points else None


def test_transfers_equal_a_plain_walk(spark):
    rng = random.Random(29)
    cases = {f"q{i}": random_transfer(rng) for i in range(60)}
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    feeder = [(q, v, w) for q, (points, *_) in cases.items() for v, w in points]
    made = forecast.Forecasts(table([], "query_id string, source string, df double, loc double, scale double"), table(feeder, "query_id string, value double, weight double"))
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(q, c, at(m), at(m + ride), live, gone, rate) for q, (_, cands, _, _) in cases.items() for c, m, ride, live, gone, rate in cands]
    rows = table(rows, "query_id string, cand_id string, dep_planned timestamp_ntz, arr_planned timestamp_ntz, dep_live double, dep_cancelled boolean, cancel_rate double")
    joint = table([(q, c, d, a, 1, w) for q, (_, _, runs, _) in cases.items() for c, d, a, w in runs], "query_id string, cand_id string, dep int, arr int, n int, weight double")
    feeders = table([(q, T0, minutes) for q, (*_, minutes) in cases.items()], "query_id string, feeder_planned timestamp_ntz, transfer_minutes int")
    samples = forecast.equal_mass_samples(made)
    out = propagate_transfer(feeders, samples, Candidates(rows, joint))
    drawn, board, points = {}, {}, {}
    for r in samples.collect():
        drawn.setdefault(r.query_id, []).append((r.delay, r.mass))
    for r in out.candidates.collect():
        board.setdefault(r.query_id, {})[r.cand_id] = r.board_probability
    for r in out.points.collect():
        points.setdefault(r.query_id, {})[r.value] = r.weight
    summary = {r.query_id: r for r in out.summary.collect()}
    headline = {r.query_id: r.catch_probability for r in headline_catch(out.candidates).collect()}
    boarded = 0
    for q, (_, cands, runs, minutes) in cases.items():
        expected = passenger(drawn[q], cands, runs, minutes)
        if expected is None:
            assert q not in summary and q not in board
            continue
        boarded += 1
        assert board[q] == pytest.approx(expected[0]) and points[q] == pytest.approx(expected[1])
        assert (summary[q].miss_probability, headline[q]) == pytest.approx(expected[2:4])
        assert summary[q].reference_arrival == at(expected[4])
    assert 20 < boarded < 60


def walk(options):
    """The traveller's walk in plain Python."""
    tried, left, found, chosen = [], P.MAX_ATTEMPTS, 0, []
    for rank in sorted({o[0] for o in options}):
        if left <= 0 or found >= P.MAX_TRANSFER_RESULTS:
            break
        own = sorted(o for o in options if o[0] == rank and o[2] not in tried)[: P.TRANSFERS_PER_FEEDER]
        for _, pick, name, works in own:
            if left <= 0:
                break
            left -= 1
            tried.append(name)
            if works:
                chosen.append((rank, pick))
                found += 1
                break
    return sorted(chosen)


def test_transfer_choice_matches_the_walk(spark):
    rng = random.Random(11)
    rows = []
    for q in range(60):
        for rank in range(1, rng.randint(2, 16)):
            names = rng.sample("ABCDEFGHIJ", rng.randint(1, 8))
            rows += [(f"q{q}", rank, pick + 1, name, rng.random() < 0.35) for pick, name in enumerate(names)]
    got = {}
    for r in journeys.choose_transfers(spark.createDataFrame(rows, "query_id string, rank int, pick int, name string, works boolean"), P.MAX_ATTEMPTS, P.MAX_TRANSFER_RESULTS, P.TRANSFERS_PER_FEEDER).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.pick))
    for q in range(60):
        assert sorted(got.get(f"q{q}", [])) == walk([r[1:] for r in rows if r[0] == f"q{q}"])


# ---------------------------------------------------------------- boards and stations


def board(spark, rows, start, hours, as_of):
    entries = spark.createDataFrame([("1", "X", c, n, line, a, d, mask, date(1970, 1, 1) + timedelta(days=seen)) for c, n, line, a, d, mask, seen in rows], schemas.BOARD_ENTRY)
    request = spark.createDataFrame([("b", "1", start, hours, as_of)], "board_id string, eva string, start timestamp_ntz, hours int, as_of date")
    return [(r.number, r.stop_id) for r in boards.plan_board(entries, request).orderBy("dep_planned").collect()]


def test_holiday_runs_the_sunday_board(spark):
    rows = [("RE", "1", "R1", None, 510, 31, 20720), ("RE", "2", "R2", None, 520, 64, 20720)]
    got = board(spark, rows, datetime(2026, 10, 3, 8), 2, date(2026, 9, 20))
    assert got == [("2", "syn-RE-2-2026-10-03")]


def test_board_window_midnight_and_last_seen(spark):
    rows = [("S", "1", None, None, 1430, 127, 20649), ("S", "2", None, None, 15, 127, 20649), ("S", "3", None, None, 200, 127, 20649), ("S", "4", None, None, 1435, 127, 20500)]
    got = board(spark, rows, datetime(2026, 7, 20, 23, 45), 2, date(2026, 7, 19))
    assert [n for n, _ in got] == ["1", "2"]


def test_route_is_ordered_and_ahead_only(spark):
    rows = [(1, 480, 0, None, None, False)]
    runs = (
        runs_of(spark, rows, place="Augsburg Hbf", eva="1")
        .unionByName(runs_of(spark, [(1, 430, 0, None, None, False)], place="Ulm Hbf", eva="2"))
        .unionByName(runs_of(spark, [(1, 520, 0, None, None, False)], place="München Hbf", eva="3"))
        .unionByName(runs_of(spark, [(1, 500, 0, None, None, False)], place="München-Pasing", eva="4"))
    )
    origin = spark.createDataFrame([("ICE_512", "1", 480)], "train_key string, origin_eva string, origin_tod int")
    assert boards.route_after(history.planned_calls(runs), origin).collect()[0].path == ["München-Pasing", "München Hbf"]


def test_station_search(spark):
    names = spark.createDataFrame([("1", "Ulm Hbf", 900), ("2", "Neu-Ulm", 950), ("3", "Köln Hbf", 999), ("4", "Ulm Ost", 5)], schemas.STATION)
    texts = spark.createDataFrame([("ulm",), ("ko",), ("hbf",), ("nowhere",), ("  ",), ("neu ulm",)], "text string")
    got = {r.text: r.eva for r in stations_op.resolve_stations(texts, names).collect()}
    assert got == {"ulm": "1", "ko": "3", "hbf": "3", "  ": "3", "neu ulm": "2"}


# ---------------------------------------------------------------- feeds

PLAN = """<timetable station='Augsburg Hbf'>
  <s id="123-2607161833-8"><tl t="p" c="RB" n="57177"/>
    <ar pt="2607161904" pp="8" l="RB86" ppth="Dinkelscherben|Neus&#228;&#223;|Augsburg-Oberhausen"/>
    <dp pt="2607161908" pp="8" l="RB86" ppth="Augsburg Haunstetterstra&#223;e|M&#252;nchen Hbf"/></s>
  <s id="456-2607161815-19"><tl c="ICE" n="512"/><ar pt="2607161938" pp="5" ppth="M&#252;nchen Hbf|M&#252;nchen-Pasing"/></s>
</timetable>"""
CHANGE = """<timetable station="Augsburg Hbf" eva="8000013">
  <s id="123-2607161833-8"><ar ct="2607161920" cp="9"/><dp ct="2607161923"/></s>
  <s id="999-unknown-1"><ar ct="2607162011"/></s>
  <s id="456-2607161815-19"><ar cs="c"/></s></timetable>"""


def log_of(spark, *documents):
    rows = [(f"hour_{i:02d}", datetime(2026, 7, 16, 18, i), api, url, xml) for i, (api, url, xml) in enumerate(documents)]
    return spark.createDataFrame(rows, "file string, timestamp timestamp_ntz, api_name string, url string, response_data string")


def test_live_board_from_documents(spark):
    log = log_of(
        spark,
        (raw_log.PLAN_API, "https://h/plan/08000013/260716/19", PLAN),
        (raw_log.CHANGE_API, "https://h/fchg/08000013", CHANGE),
        (raw_log.PLAN_API, "https://h/plan/08000013/260716/20", "<broken"),
        (raw_log.PLAN_API, "https://h/other", PLAN),
        ("other/api", "https://h/plan/1", PLAN),
    )
    got = {r.stop_id: r for r in condense.live_board(raw_log.plan_stops(log), raw_log.change_stops(log)).collect()}
    rb, ice = got["123-2607161833-8"], got["456-2607161815-19"]
    assert (rb.eva, rb.line, rb.origin, rb.destination) == ("8000013", "RB86", "Dinkelscherben", "München Hbf")
    assert rb.arr_changed == datetime(2026, 7, 16, 19, 20) and rb.arr_best_platform == "9" and rb.dep_best_platform == "8"
    assert ice.arr_cancelled and not ice.dep_present and ice.dep_best is None and len(got) == 2


def test_daily_fold_keeps_older_values_and_live_board_does_not(spark):
    later = '<timetable><s id="123-2607161833-8"><ar cs="p"/><dp cs="c"/></s></timetable>'
    log = log_of(
        spark,
        (raw_log.PLAN_API, "https://h/plan/08000013/260716/19", PLAN),
        (raw_log.CHANGE_API, "https://h/fchg/08000013", CHANGE),
        (raw_log.CHANGE_API, "https://h/fchg/08000013", later),
    )
    day = {r.train_number: r for r in condense.condense_day(log).collect()}
    assert day["57177"].arrival_change_time == datetime(2026, 7, 16, 19, 20) and day["57177"].is_canceled
    assert day["57177"].train_line_ride_id == "123-2607161833" and day["57177"].train_line_station_num == 8
    assert day["512"].is_canceled and day["512"].arrival_change_time == day["512"].arrival_planned_time
    live = {r.number: r for r in condense.live_board(raw_log.plan_stops(log), raw_log.change_stops(log)).collect()}
    assert live["57177"].arr_changed is None and live["57177"].dep_cancelled
    assert condense.condense_day(log, ["1"]).count() == 0


# ---------------------------------------------------------------- backtest


def test_delta_beats_blind_where_the_last_stop_tells(spark):
    rng = random.Random(1)
    rows = []
    for ago in range(60):
        prev = rng.randint(0, 40)
        rows.append(("1", "ICE", "5", TODAY - timedelta(days=ago), 600, prev + rng.randint(-1, 2), prev))
    df = spark.createDataFrame(rows, "eva string, train_type string, train_number string, day date, tod int, delay int, prev int")
    scores = {(r.variant, r.scenario): r for r in backtest.backtest(df, 2).filter("bucket = 'all'").collect()}
    assert len(scores) == 32 and scores["uniform", "blind"].n == 15
    assert scores["hl30_wd2_delta", "live"].crps < scores["hl30_wd2_kernel", "live"].crps < scores["hl30_wd2", "live"].crps
    assert scores["hl30_wd2", "live"].crps == scores["hl30_wd2", "blind"].crps
    few = df.filter("day > '2026-06-18'")
    assert backtest.backtest(few, 2).count() == 0
