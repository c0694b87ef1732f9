"""Empirical delay distributions for a table of queries.

A query is ``(query_id, train_key, station_name, tod, as_of, live)``.  Runs are
first counted per distinct ``(day, time of day, final delay, previous delay)``,
then the days are folded away per reference date, and only these cells meet the
queries.  What a query reads is bounded by the value ranges of delays and of the
time-of-day window, not by how many runs a connection has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays
from lagcast.operators import distribution as D
from lagcast.operators.prepare import usable

PLACE = ["train_key", "station_name"]


def run_cells(runs: DataFrame) -> DataFrame:
    """Counted usable runs; the count combines map-side."""
    return (
        runs.filter(usable())
        .groupBy(
            *PLACE,
            "day",
            "tod",
            delays.final_delay(F.col("arr_delay"), F.col("dep_delay")).alias("final"),
            F.col("prev_delay").alias("prev"),
        )
        .agg(F.count("*").alias("n"))
    )


def call_counts(runs: DataFrame) -> DataFrame:
    """Runs and cancelled runs per planned time."""
    return runs.groupBy(*PLACE, "tod").agg(
        F.count("*").alias("calls"), F.sum(F.col("cancelled").cast("int")).alias("dropped")
    )


def slots(tod: str):
    """Generated column of the time slots a query has to look at."""
    return F.explode(delays.near_slots(F.col(tod))).alias("slot")


def with_slot(cells: DataFrame, tod: str = "tod") -> DataFrame:
    return cells.withColumn("slot", delays.tod_slot(F.col(tod)))


def cancel_rates(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """Share of cancelled runs in the window of each query (no row without runs)."""
    asked = queries.select("query_id", *PLACE, F.col("tod").alias("q_tod"), slots("tod"))
    return (
        asked.join(with_slot(call_counts(runs)), [*PLACE, "slot"])
        .filter(delays.same_connection(F.col("tod"), F.col("q_tod")))
        .groupBy("query_id")
        .agg((F.sum("dropped") / F.sum("calls")).alias("cancel_rate"), F.sum("calls").alias("calls"))
    )


def fold_days(cells: DataFrame, wanted: DataFrame, extra: list[str]) -> DataFrame:
    """Sum run weights over days for each reference date of each place.

    ``wanted`` has ``PLACE``, ``as_of`` and optionally ``live_known``; without a
    live query the previous delay is dropped from the cells.
    """
    w = delays.run_weight(F.col("day"), F.col("as_of"))
    joined = cells.join(wanted, PLACE)
    if "live_known" in wanted.columns:
        joined = joined.withColumn("prev", F.when(F.col("live_known"), F.col("prev")))
    return joined.groupBy(*PLACE, "as_of", "tod", *extra).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * w).alias("w"), F.sum(F.col("n") * w * w).alias("w2")
    )


def empirical_points(runs: DataFrame, queries: DataFrame) -> DataFrame:
    """Points ``(query_id, value, weight, w2, sample, on_live)`` of each answerable query.

    With a live delay and at least eight runs whose previous delay is known, a
    run contributes the live delay plus its last-hop change, weighted toward
    runs that looked like the live one.  Otherwise its final delay counts.
    """
    asked = queries.select("query_id", *PLACE, F.col("tod").alias("q_tod"), "as_of", F.col("live").cast("double"))
    wanted = asked.groupBy(*PLACE, "as_of").agg(F.max(F.col("live").isNotNull()).alias("live_known"))
    folded = fold_days(run_cells(runs), wanted, ["final", "prev"])
    near = (
        asked.withColumn("slot", F.explode(delays.near_slots(F.col("q_tod"))))
        .join(with_slot(folded), [*PLACE, "as_of", "slot"])
        .filter(delays.same_connection(F.col("tod"), F.col("q_tod")))
        .groupBy("query_id", "live", "final", F.when(F.col("live").isNotNull(), F.col("prev")).alias("prev"))
        .agg(*[F.sum(c).alias(c) for c in ("n", "w", "w2")])
    )
    per_query = Window.partitionBy("query_id")
    known = F.sum(F.when(F.col("prev").isNotNull(), F.col("n"))).over(per_query)
    counted = near.withColumns(
        {
            "sample": F.sum("n").over(per_query),
            "on_live": F.col("live").isNotNull() & (F.coalesce(known, F.lit(0)) >= P.MIN_EFFECTIVE_N),
        }
    ).filter(~F.col("on_live") | F.col("prev").isNotNull())
    moved = F.col("live") + F.col("final") - F.col("prev")
    factor = F.when(F.col("on_live"), delays.likeness(F.col("prev"), F.col("live"))).otherwise(1.0)
    return (
        counted.select(
            "query_id",
            "sample",
            "on_live",
            F.when(F.col("on_live"), moved).otherwise(F.col("final").cast("double")).alias("value"),
            (F.col("w") * factor).alias("weight"),
            (F.col("w2") * factor * factor).alias("w2"),
        )
        .groupBy("query_id", "value")
        .agg(
            F.sum("weight").alias("weight"),
            F.sum("w2").alias("w2"),
            F.max("sample").alias("sample"),
            F.max("on_live").alias("on_live"),
        )
    )


def sample_sizes(points: DataFrame) -> DataFrame:
    """Usable runs and effective sample size of each query."""
    return points.groupBy("query_id").agg(
        F.max("sample").alias("sample"),
        D.effective_n(F.sum("weight"), F.sum("w2")).alias("effective_n"),
        F.max("on_live").alias("on_live"),
    )
