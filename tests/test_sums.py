"""Running and suffix sums against plain sums, and shared requests."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lagcast.operators import boards, transfer
from lagcast.plans import backtest, connections


def test_folded_history_equals_plain_sums(spark):
    rng, first = random.Random(8), date(2024, 12, 10)
    rows = []
    for _ in range(400):
        rows.append(("1", "S", rng.choice("12"), first + timedelta(days=rng.randrange(60)), rng.choice([600, 610]), rng.randrange(3), rng.choice([None, 0, 5])))
    frame = spark.createDataFrame(rows, "eva string, train_type string, train_number string, day date, tod int, delay int, prev int")
    states, _ = backtest.with_states(backtest.evaluated(frame, 3))
    folded = backtest.fold_history(frame, states).collect()
    wanted = [("w_uniform", None, None, 1, False), ("w_hl7", 7, None, 1, False), ("w_window35", None, 35, 1, False), ("w_hl14_wd2_hol", 14, None, 2, True), ("w_hl30_wd4", 30, None, 4, False)]
    holidays = {date(2024, 12, 25), date(2024, 12, 26), date(2025, 1, 1), date(2025, 1, 6)}
    kind = lambda d, hol: 6 if hol and d in holidays else d.weekday()
    sums = defaultdict(lambda: [0] + [0.0] * len(wanted))
    for at in {(r.eva, r.train_type, r.train_number, r.day) for r in states.collect()}:
        for *conn, day, tod, delay, prev in rows:
            if tuple(conn) == at[:3] and day < at[3]:
                cell = sums[(*at, tod, prev, delay)]
                cell[0] += 1
                for i, (_, half, window, boost, hol) in enumerate(wanted, 1):
                    age = (at[3] - day).days
                    if window is None or age <= window:
                        cell[i] += 2 ** (-age / half if half else 0) * (boost if kind(day, hol) == kind(at[3], hol) else 1)
    assert len(folded) == len(sums) > 50
    for r in folded:
        cell = sums[(r.eva, r.train_type, r.train_number, r.day, r.run_tod, r.prev, r.final)]
        assert [r.n] + [r[name] for name, *_ in wanted] == pytest.approx(cell)
    assert "LessThan" not in backtest.fold_history(frame, states)._jdf.queryExecution().optimizedPlan().toString()


def test_suffix_sums_equal_plain_sums(spark):
    rng = random.Random(3)
    deps = [("q", c, d, rng.random()) for c in "ab" for d in rng.sample(range(-5, 40), 12)]
    limits = sorted({("q", c, rng.choice([-9.0, 3.0, 12.5, 39.0, 50.0, float(deps[0][2])])) for c in "abc" for _ in range(8)})
    by_dep = spark.createDataFrame(deps, "query_id string, cand_id string, dep int, weight double")
    thresholds = spark.createDataFrame(limits, "query_id string, cand_id string, threshold double")
    got = {(r.cand_id, r.threshold): r.stay for r in transfer.still_to_leave(thresholds, by_dep).collect()}
    for _, c, t in limits:
        own = [(d, w) for _, k, d, w in deps if k == c]
        assert got[(c, t)] == pytest.approx(sum(w for d, w in own if d >= t) / sum(w for _, w in own) if own else 0.0)
    samples = thresholds.withColumns({"through": F.lit(0.25), "base": F.lit(4.0)})
    reached = {(r.cand_id, r.dep): (r.through, r.base) for r in transfer.reached_before(samples, by_dep).collect()}
    expected = {(c, float(d)): 0.25 * sum(1 for _, k, t in limits if k == c and t <= d) for _, c, d, _ in deps}
    assert reached == {k: (v, 4.0) for k, v in expected.items() if v}


def test_equal_requests_are_planned_once(spark):
    rows = [("a", "S", None, 1), ("b", "S", None, 1), ("c", "S", "S1", 1), ("d", "RE", None, 1), ("d", "S", None, 1)]
    shared, askers = connections.shared_requests(spark.createDataFrame(rows, "query_id string, category string, line string, minutes int"))
    assert shared.count() == 3 and askers.count() == 5
    back = connections.for_askers(shared, askers)
    assert sorted(tuple(r) for r in back.select("query_id", "category").collect()) == sorted((r[0], r[1]) for r in rows)


def test_routes_by_frames_equal_plain_walks(spark):
    rng = random.Random(12)
    calls = sorted({(t, rng.choice("ABCDE"), rng.choice(["1", "2", None]), rng.randrange(1440)) for t in ("x", "y") for _ in range(40)}, key=repr)
    frame = spark.createDataFrame([(t, s, e, m, date(2024, 1, 1)) for t, s, e, m in calls], "train_key string, station_name string, eva string, tod int, last_day date")
    origins = frame.select("train_key", F.col("eva").alias("origin_eva"), F.col("tod").alias("origin_tod"))
    got = {(r.train_key, r.origin_eva, r.origin_tod): r.path for r in boards.route_after(frame, origins).collect()}
    expected = {}
    for t, _, eva, tod in calls:
        ahead = defaultdict(lambda: 9999)
        for t2, s, e, m in calls:
            if t2 == t and e != eva and 1 <= (m - tod) % 1440 < 600:
                ahead[s] = min(ahead[s], (m - tod) % 1440)
        if ahead:
            expected[(t, eva, tod)] = [s for _, s in sorted((a, s) for s, a in ahead.items())]
    assert got == expected
