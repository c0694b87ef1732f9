"""Bayesian fallback: one conjugate normal model per train class and time band."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions import delays

BUCKET = ["train_class", "time_band"]


def priors(spark: SparkSession) -> DataFrame:
    """Four fixed rows."""
    rows = [(name, *values) for name, values in P.PRIORS.items()]
    return spark.createDataFrame(rows, "train_class string, mu0 double, kappa0 double, alpha0 double, beta0 double")


def observations(prepared: DataFrame) -> DataFrame:
    """Final delays of completed stops with their class and band."""
    final = delays.final_delay(F.col("arr_delay"), F.col("dep_delay"))
    return prepared.filter(~F.col("is_canceled") & final.isNotNull()).select(
        delays.train_class(F.col("train_type")).alias("train_class"),
        delays.time_band(F.col("planned")).alias("time_band"),
        final.cast("double").alias("delay"),
    )


def bucket_stats(observed: DataFrame) -> DataFrame:
    """Count, mean and sum of squared deviations of the clamped delays.

    Spark merges partial moments, so sixteen groups do not become sixteen tasks
    with all the rows.
    """
    x = delays.clamp(F.col("delay"), float(P.BUCKET_MIN), float(P.BUCKET_MAX))
    return (
        observed.select(*BUCKET, x.alias("x"))
        .groupBy(*BUCKET)
        .agg(
            F.count("x").alias("n"),
            F.avg("x").alias("mean"),
            (F.var_pop("x") * F.count("x")).alias("m2"),
        )
    )


def posterior_predictive(wanted: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Adds Student-t parameters ``df, loc, scale`` to rows with class and band.

    Priors and statistics have at most 4 and 16 rows.
    """
    joined = wanted.join(F.broadcast(priors(wanted.sparkSession)), "train_class", "left")
    if stats is None:
        joined = joined.withColumns({"n": F.lit(0), "mean": F.lit(0.0), "m2": F.lit(0.0)})
    else:
        joined = joined.join(F.broadcast(stats.select(*BUCKET, "n", "mean", "m2")), BUCKET, "left")
    n = F.coalesce("n", F.lit(0)).cast("double")
    mean, m2 = F.coalesce("mean", F.lit(0.0)), F.coalesce("m2", F.lit(0.0))
    mu0, kappa0 = F.col("mu0"), F.col("kappa0")
    kappa = kappa0 + n
    alpha = F.col("alpha0") + n / 2
    beta = F.col("beta0") + m2 / 2 + kappa0 * n * (mean - mu0) * (mean - mu0) / (2 * kappa)
    return joined.withColumns(
        {
            "df": 2 * alpha,
            "loc": (kappa0 * mu0 + n * mean) / kappa,
            "scale": F.sqrt(beta * (kappa + 1) / (alpha * kappa)),
            "observations": n.cast("long"),
        }
    ).drop("n", "mean", "m2", "mu0", "kappa0", "alpha0", "beta0")


def anchor_live(predictive: DataFrame, live: str = "live") -> DataFrame:
    """Moves the predictive onto a live report where there is one."""
    known = F.col(live).isNotNull()
    return predictive.withColumns(
        {
            "loc": F.when(known, F.col(live)).otherwise(F.col("loc")),
            "scale": F.when(
                known, F.greatest(F.col("scale") * P.LIVE_SHRINKAGE, F.lit(P.MIN_LIVE_SCALE))
            ).otherwise(F.col("scale")),
        }
    )
