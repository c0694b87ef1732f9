"""Transfer candidates and the propagation of a feeder's delay through them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays, text, times
from lagcast.operators.boards import with_train_key
from lagcast.operators.empirical import PLACE, cancel_rates, slots, with_slot
from lagcast.operators.forecast import match_station
from lagcast.operators.prepare import usable
from lagcast.session import materialize


def match_destination(rows: DataFrame, index: DataFrame, name: str, out: str, eva: str | None, both_ways: bool) -> DataFrame:
    """History station of a train that is the destination: number, exact name, loose name."""
    pairs = rows.select("train_key", name, *([eva] if eva else [])).distinct()
    tested = pairs.join(index, "train_key")
    same_eva = F.col("eva") == F.col(eva) if eva else F.lit(False)
    exact = F.lower("station_name") == F.lower(F.col(name))
    loose = text.name_reaches(F.col("station_name"), F.col(name), both_ways)
    keys = pairs.columns
    turn = F.when(same_eva, 0).when(exact, 1).when(loose, 2)
    best = (
        tested.withColumn("turn", turn)
        .filter("turn is not null")
        .groupBy(*keys)
        .agg(F.min(F.struct("turn", "station_name"))["station_name"].alias(out))
    )
    return rows.join(best, keys, "left")


def leaving_cells(runs: DataFrame) -> DataFrame:
    """Counted runs by departure delay (arrival delay where unknown)."""
    delay = delays.leave_delay(F.col("arr_delay"), F.col("dep_delay"))
    return (
        runs.filter(usable()).groupBy(*PLACE, "day", "tod", delay.alias("dep")).agg(F.count("*").alias("n"))
    )


def last_arrivals(runs: DataFrame) -> DataFrame:
    """Last run of each train at each station and date."""
    final = delays.final_delay(F.col("arr_delay"), F.col("dep_delay"))
    return (
        runs.filter(usable())
        .groupBy(*PLACE, "day")
        .agg(F.max(F.struct("tod", final.alias("arr"))).alias("last"))
        .select(*PLACE, "day", F.col("last.tod").alias("arr_tod"), F.col("last.arr").alias("arr"))
    )


def latest_arrival_tod(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy(*PLACE).agg(F.max_by("arr_tod", "day").alias("arr_tod"))


@dataclass(frozen=True)
class Candidates:
    """``rows``: one per candidate; ``joint``: its ``(dep, arr)`` delay cells with run count and weight."""

    rows: DataFrame
    joint: DataFrame


CANDIDATE = ["query_id", "cand_id"]


def build_candidates(departures: DataFrame, runs: DataFrame, index: DataFrame) -> Candidates:
    """Delay statistics of candidate departures.

    ``departures``: ``query_id, cand_id, category, number, line, dep_planned,
    dep_live, dep_cancelled, transfer_eva, transfer_name, destination, as_of``.
    Departure and arrival delay of a candidate come from the same date; days are
    folded per leg before the candidates join, as in the forecast.
    """
    keyed = with_train_key(departures, index).withColumn("tod", times.minute_of_day(F.col("dep_planned")))
    uid = F.struct("query_id", "cand_id")
    located = match_station(
        keyed.withColumns({"row_query": F.col("query_id"), "query_id": uid, "eva": F.col("transfer_eva"), "place": F.col("transfer_name")}),
        index,
    )
    ended = materialize(match_destination(located, index, "destination", "dest_station", None, False))

    arrivals = last_arrivals(runs)
    arrival_tod = latest_arrival_tod(arrivals).select(
        "train_key", F.col("station_name").alias("dest_station"), "arr_tod"
    )
    rates = cancel_rates(runs, ended.filter("station_name is not null")).select("query_id", "cancel_rate")

    leg = ["train_key", "station_name", "dest_station", "as_of"]
    legs = ended.filter("station_name is not null and dest_station is not null").select(*leg).distinct()
    to = arrivals.select("train_key", F.col("station_name").alias("dest_station"), "day", "arr")
    cells = (
        legs.join(leaving_cells(runs), PLACE)
        .join(to, ["train_key", "dest_station", "day"])
        .groupBy(*leg, F.col("tod").alias("run_tod"), "dep", "arr")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * delays.run_weight(F.col("day"), F.col("as_of"))).alias("weight"),
        )
    )
    joint = materialize(
        ended.select("query_id", "tod", *leg, slots("tod"))
        .join(with_slot(cells, "run_tod"), [*leg, "slot"])
        .filter(delays.same_connection(F.col("run_tod"), F.col("tod")))
        .groupBy("query_id", "dep", "arr")
        .agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    )
    counts = joint.groupBy("query_id").agg(F.sum("n").alias("joint_runs"))
    rows = (
        ended.join(counts, "query_id", "left")
        .join(arrival_tod, ["train_key", "dest_station"], "left")
        .join(rates, "query_id", "left")
        .withColumns(
            {
                "joint_runs": F.coalesce("joint_runs", F.lit(0)),
                "cancel_rate": F.coalesce("cancel_rate", F.lit(0.0)),
                "arr_planned": times.next_at(F.col("dep_planned"), F.col("arr_tod")),
            }
        )
        .filter(F.col("arr_planned").isNotNull())
        .filter(
            (F.col("joint_runs") >= P.MIN_JOINT_RUNS) | F.col("dep_live").isNotNull() | F.col("dep_cancelled")
        )
    )
    kept = rows.select(
        F.col("row_query").alias("query_id"),
        "cand_id",
        "category",
        "number",
        "line",
        "dep_planned",
        "arr_planned",
        "dep_live",
        "dep_cancelled",
        "cancel_rate",
        "joint_runs",
    )
    return Candidates(
        materialize(kept),
        joint.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.cand_id").alias("cand_id"), "dep", "arr", "n", "weight"),
    )


@dataclass(frozen=True)
class Transfers:
    """``summary``: ``query_id, reference_arrival, miss_probability``;
    ``candidates``: board probability of each; ``points``: arrival delays in
    minutes relative to the reference arrival, given that a train is boarded."""

    summary: DataFrame
    candidates: DataFrame
    points: DataFrame


def _merged(thresholds: DataFrame, departures: DataFrame) -> DataFrame:
    """Thresholds and departure delays of each candidate as one list of values to be sorted; at most a row per sample and delay."""
    return thresholds.withColumn("leaves", F.lit(False)).withColumnRenamed("threshold", "value").unionByName(
        departures.withColumn("leaves", F.lit(True)).withColumn("dep", F.col("dep").cast("double")).withColumnRenamed("dep", "value"),
        allowMissingColumns=True,
    )


def still_to_leave(thresholds: DataFrame, by_dep: DataFrame) -> DataFrame:
    """``stay``: share of a candidate's weight that leaves at or after each threshold.

    As-of lookup by suffix sums: one sort of thresholds and departures, the weight carried from the latest back.
    """
    later = Window.partitionBy(*CANDIDATE).orderBy(F.desc("value"), F.desc("leaves")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*CANDIDATE)
    share = F.try_divide(F.sum("weight").over(later), F.sum("weight").over(whole))
    sums = _merged(thresholds, by_dep).withColumn("stay", F.least(F.coalesce(share, F.lit(0.0)), F.lit(1.0)))
    return sums.filter("not leaves").select(*CANDIDATE, F.col("value").alias("threshold"), "stay")


def reached_before(samples: DataFrame, by_dep: DataFrame) -> DataFrame:
    """``through``: chance to reach a candidate in time for each of its departure delays, by running sums over the thresholds."""
    sooner = Window.partitionBy(*CANDIDATE).orderBy("value", "leaves").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*CANDIDATE)
    sums = _merged(samples, by_dep.drop("weight")).withColumns(
        {"through": F.sum("through").over(sooner), "base": F.max("base").over(whole)}
    )
    return sums.filter("leaves and through > 0").select(*CANDIDATE, F.col("value").alias("dep"), "through", "base")


def propagate_transfer(feeders: DataFrame, samples: DataFrame, made: Candidates) -> Transfers:
    """Boards the first candidate that is still there when the passenger is ready.

    ``feeders``: ``query_id, feeder_planned, transfer_minutes``; ``samples``:
    ``query_id, delay, mass``.  The chance to reach a candidate is the product
    of the chances that all earlier ones were gone, hence a running product
    over a query's candidates per sample.
    """
    joint = made.joint.groupBy(*CANDIDATE, "dep", "arr").agg(F.sum("weight").alias("weight"))
    totals = joint.groupBy(*CANDIDATE).agg(F.sum("weight").alias("total"))
    rows = (
        made.rows.join(feeders, "query_id")
        .join(totals, CANDIDATE, "left")
        .filter(F.col("dep_cancelled") | F.col("dep_live").isNotNull() | F.col("total").isNotNull())
    )
    in_order = F.struct("dep_planned", "cand_id")
    reference = rows.filter("not dep_cancelled").groupBy("query_id").agg(
        F.min_by("arr_planned", in_order).alias("reference_arrival")
    )
    rows = materialize(
        rows.join(reference, "query_id").withColumns(
            {
                "base": F.timestamp_diff("SECOND", times.instant(F.col("reference_arrival")), times.instant(F.col("arr_planned"))) / 60.0,
                "head_start": F.timestamp_diff("MILLISECOND", times.instant(F.col("dep_planned")), times.instant(F.col("feeder_planned"))),
            }
        )
    )
    reference = rows.select("query_id", "reference_arrival").distinct()
    ready = ((F.col("delay") + F.col("transfer_minutes")) * 60000).cast("long")
    met = samples.join(rows, "query_id").withColumn("threshold", (ready + F.col("head_start")) / 60000.0)

    # Share of a candidate's runs that leave at or after each threshold.
    by_dep = joint.groupBy(*CANDIDATE, "dep").agg(F.sum("weight").alias("weight"))
    thresholds = met.filter("not dep_cancelled and dep_live is null").select(*CANDIDATE, "threshold").distinct()
    staying = still_to_leave(thresholds, by_dep)
    p_board = (
        F.when(F.col("dep_cancelled"), 0.0)
        .when(F.col("dep_live").isNotNull(), (F.col("dep_live") >= F.col("threshold")).cast("double"))
        .otherwise((1 - F.col("cancel_rate")) * F.coalesce("stay", F.lit(0.0)))
    )
    earlier = (
        Window.partitionBy("query_id", "delay").orderBy("dep_planned", "cand_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = materialize(
        met.join(staying, [*CANDIDATE, "threshold"], "left")
        .withColumn("p_board", p_board)
        .withColumn("reach", F.col("mass") * F.coalesce(F.product(1 - F.col("p_board")).over(earlier), F.lit(1.0)))
        .withColumn("boarded", F.col("reach") * F.col("p_board"))
    )
    boarding = reached.groupBy(*CANDIDATE).agg(F.sum("boarded").alias("board_probability"))
    left_over = reached.groupBy("query_id", "delay").agg(
        (F.max("mass") * F.product(1 - F.col("p_board"))).alias("missed")
    )
    missed = left_over.groupBy("query_id").agg(F.sum("missed").alias("miss_probability"))

    # Arrival points.  A run counts for every sample whose threshold it outstays.
    blind = reached.filter("not dep_cancelled and dep_live is null").select(
        *CANDIDATE, "threshold", "base", (F.col("reach") * (1 - F.col("cancel_rate"))).alias("through")
    )
    per_dep = reached_before(blind, by_dep)
    blind_points = (
        joint.withColumn("dep", F.col("dep").cast("double")).join(per_dep, [*CANDIDATE, "dep"])
        .join(totals, CANDIDATE)
        .select(
            "query_id",
            (F.col("base") + F.col("arr")).alias("value"),
            (F.col("through") * F.col("weight") / F.col("total")).alias("weight"),
        )
    )
    held = (
        reached.filter("not dep_cancelled and dep_live is not null")
        .groupBy(*CANDIDATE)
        .agg(F.sum("boarded").alias("through"), F.max("base").alias("base"), F.max("dep_live").alias("live"), F.max("total").alias("total"))
    )
    live_points = held.join(joint, CANDIDATE, "left").select(
        "query_id",
        (F.col("base") + F.col("live") + F.coalesce(F.col("arr") - F.col("dep"), F.lit(0))).alias("value"),
        (F.col("through") * F.coalesce(F.col("weight") / F.col("total"), F.lit(1.0))).alias("weight"),
    )
    points = materialize(
        blind_points.unionByName(live_points)
        .filter("weight > 0")
        .groupBy("query_id", "value")
        .agg(F.sum("weight").alias("weight"))
    )
    summary = reference.join(missed, "query_id").join(points.select("query_id").distinct(), "query_id", "left_semi")
    listed = (
        rows.select(*CANDIDATE, "dep_planned", "arr_planned", "dep_cancelled", "feeder_planned")
        .join(boarding, CANDIDATE, "left")
        .withColumn("board_probability", F.coalesce("board_probability", F.lit(0.0)))
        .join(summary.select("query_id"), "query_id", "left_semi")
    )
    return Transfers(summary, listed, points)


def headline_catch(candidates: DataFrame) -> DataFrame:
    """Catch probability of the first running candidate after the feeder's planned
    arrival, else of the first running one."""
    order = F.struct("dep_planned", "cand_id")
    runs = ~F.col("dep_cancelled")
    later = runs & (F.col("dep_planned") >= F.col("feeder_planned"))
    first = F.struct(order.alias("o"), "board_probability")
    return candidates.groupBy("query_id").agg(
        F.coalesce(
            F.min(F.when(later, first))["board_probability"], F.min(F.when(runs, first))["board_probability"]
        ).alias("catch_probability")
    )
