"""Arrival-delay forecasts for a table of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays, times
from lagcast.functions.student_t import t_cdf, t_quantile
from lagcast.operators import distribution as D
from lagcast.operators.boards import with_train_key
from lagcast.operators.bucket_model import anchor_live, posterior_predictive
from lagcast.operators.empirical import cancel_rates, empirical_points, sample_sizes
from lagcast.operators.history import station_index
from lagcast.session import materialize


@dataclass(frozen=True)
class Forecasts:
    """``summary`` has one row per query, ``points`` the empirical distributions.

    A query whose source is PRIOR has no points; its distribution is the
    Student-t in ``df, loc, scale``.
    """

    summary: DataFrame
    points: DataFrame


def match_station(queries: DataFrame, index: DataFrame) -> DataFrame:
    """History station of each query: by number, else by name ignoring case.

    Two equi-joins instead of one ``OR`` condition; ties go to the first name.
    Needs ``query_id, train_key, eva, place`` and adds ``station_name``.
    """
    lookup = queries.select("query_id", "train_key", F.col("eva").alias("q_eva"), F.lower("place").alias("q_place"))
    by_eva = lookup.join(
        index.withColumnRenamed("eva", "q_eva"), ["train_key", "q_eva"]
    ).select("query_id", F.lit(0).alias("turn"), "station_name")
    by_name = lookup.join(
        index.withColumn("q_place", F.lower("station_name")).drop("eva"), ["train_key", "q_place"]
    ).select("query_id", F.lit(1).alias("turn"), "station_name")
    best = by_eva.unionByName(by_name).groupBy("query_id").agg(
        F.min(F.struct("turn", "station_name"))["station_name"].alias("station_name")
    )
    return queries.join(best, "query_id", "left")


def forecast(
    queries: DataFrame, runs: DataFrame, stats: DataFrame | None = None, index: DataFrame | None = None
) -> Forecasts:
    """Forecast of each ``(query_id, category, number, line, eva, place, planned, live, as_of)``.

    The placed queries and the points (a few hundred per query at most) have
    several readers and are stored once.
    """
    index = station_index(runs) if index is None else index
    located = match_station(with_train_key(queries, index), index)
    asked = materialize(located.withColumn("tod", times.minute_of_day(F.col("planned"))))
    known = asked.filter("station_name is not null")
    points = materialize(empirical_points(runs, known))
    enough = sample_sizes(points).filter(F.col("effective_n") >= P.MIN_EFFECTIVE_N)
    rated = enough.join(cancel_rates(runs, known), "query_id", "left")
    fallback = anchor_live(
        posterior_predictive(
            asked.withColumns(
                {
                    "train_class": delays.train_class(F.col("category")),
                    "time_band": delays.time_band(F.col("planned")),
                }
            ),
            stats,
        )
    )
    found = F.col("sample").isNotNull()
    summary = fallback.join(rated, "query_id", "left").select(
        *queries.columns,
        "train_key",
        "station_name",
        F.when(F.col("on_live"), "EMPIRICAL_LIVE").when(found, "EMPIRICAL").otherwise("PRIOR").alias("source"),
        F.coalesce("sample", F.lit(0)).alias("run_count"),
        F.coalesce("effective_n", F.lit(0.0)).alias("effective_runs"),
        F.when(found, F.col("cancel_rate")).alias("cancel_probability"),
        *[F.when(~found, F.col(c)).alias(c) for c in ("df", "loc", "scale")],
    )
    kept = points.join(enough.select("query_id"), "query_id", "left_semi").select("query_id", "value", "weight")
    return Forecasts(summary, kept)


CARD = {"median": 0.5, "q10": 0.1, "q90": 0.9}


def forecast_cards(made: Forecasts) -> DataFrame:
    """Median, 80 % interval and chance of at most five minutes for each query."""
    shape = D.card(made.points, ["query_id"])
    joined = made.summary.join(shape, "query_id", "left")
    prior = F.col("source") == "PRIOR"
    params = [F.col(c) for c in ("df", "loc", "scale")]
    return joined.withColumns(
        {
            **{
                name: F.when(prior, t_quantile(F.lit(p), *params)).otherwise(F.col(name))
                for name, p in CARD.items()
            },
            "p_within5": F.when(prior, t_cdf(F.lit(5.0), *params)).otherwise(F.col("p_within5")),
        }
    )


def equal_mass_samples(made: Forecasts, n: int = P.FEEDER_SAMPLES) -> DataFrame:
    """``n`` equal-mass delays of each forecast, equal ones merged: ``(query_id, delay, mass)``.

    The i-th level lies at ``(i + 0.5) / n``.  From a distribution with shares,
    a value takes the levels between its predecessor's share and its own.
    """
    by_value = Window.partitionBy("query_id").orderBy("value")
    shares = D.with_shares(made.points, ["query_id"]).withColumn(
        "before", F.coalesce(F.lag("share").over(by_value), F.lit(0.0))
    )

    def levels(share):
        # Levels at or below a share.
        return F.least(F.lit(n), F.floor(F.round(share * n - 0.5, 7)) + 1)

    empirical = shares.select(
        "query_id", F.col("value").alias("delay"), ((levels(F.col("share")) - levels(F.col("before"))) / n).alias("mass")
    ).filter("mass > 0")
    parametric = (
        made.summary.filter("source = 'PRIOR'")
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        .select(
            "query_id",
            t_quantile((F.col("i") + 0.5) / n, F.col("df"), F.col("loc"), F.col("scale")).alias("delay"),
            F.lit(1.0 / n).alias("mass"),
        )
    )
    return empirical.unionByName(parametric)
