"""Weighted empirical distributions as long tables ``(keys, value, weight)``.

Weights are summed per value before anything is ordered.  Delays are whole
minutes in a fixed range, so a distribution has a few hundred values at most and
the per-distribution windows stay small whatever the number of runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cumulative shares are compared after rounding, so that engines summing in
# another order pick the same value.
SHARE_DIGITS = 9


def summed(points: DataFrame, keys: list[str], weights: tuple[str, ...] = ("weight",)) -> DataFrame:
    return points.groupBy(*keys, "value").agg(*[F.sum(w).alias(w) for w in weights])


def effective_n(weight: Column, square: Column) -> Column:
    """(sum w)^2 / sum w^2 from the two sums; 0 without weight."""
    return F.when(square > 0, weight * weight / square).otherwise(F.lit(0.0))


def with_shares(points: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Adds ``total``, cumulative ``cum`` and rounded ``share`` to per-value points."""
    group = Window.partitionBy(*keys)
    upto = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return points.withColumns(
        {"cum": F.sum(weight).over(upto), "total": F.sum(weight).over(group)}
    ).withColumn("share", F.round(F.col("cum") / F.col("total"), SHARE_DIGITS))


def quantile_of(p: float, value: str = "value", share: str = "share") -> Column:
    """Aggregate: least value whose share reaches ``p`` (over rows with shares)."""
    return F.min(F.when(F.col(share) >= p, F.col(value)))


def cdf_of(x: Column | float, value: str = "value", weight: str = "weight") -> Column:
    """Aggregate: weight share of values up to ``x``."""
    x = x if isinstance(x, Column) else F.lit(x)
    return F.sum(F.when(F.col(value) <= x, F.col(weight)).otherwise(0.0)) / F.sum(weight)


def quantiles(points: DataFrame, keys: list[str], ps: dict[str, float]) -> DataFrame:
    """Weighted quantiles, one column per name."""
    return (
        with_shares(summed(points, keys), keys)
        .groupBy(*keys)
        .agg(*[quantile_of(p).alias(name) for name, p in ps.items()])
    )


def card(points: DataFrame, keys: list[str]) -> DataFrame:
    """Median, 80 % interval and the chance of at most five minutes."""
    return (
        with_shares(summed(points, keys), keys)
        .groupBy(*keys)
        .agg(
            quantile_of(0.5).alias("median"),
            quantile_of(0.1).alias("q10"),
            quantile_of(0.9).alias("q90"),
            cdf_of(5.0).alias("p_within5"),
        )
    )


def crps_terms(points: DataFrame, keys: list[str], observed: Column) -> DataFrame:
    """Exact CRPS of each distribution against ``observed`` (constant per key)."""
    w = F.col("weight") / F.col("total")
    after = 1.0 - F.col("cum") / F.col("total")
    before = (F.col("cum") - F.col("weight")) / F.col("total")
    term = w * F.abs(F.col("value") - observed) - w * F.col("value") * (before - after)
    return with_shares(points, keys).groupBy(*keys).agg(F.sum(term).alias("crps"))


def pinball(predicted: Column, observed: Column, q: float) -> Column:
    return F.when(observed < predicted, (1 - q) * (predicted - observed)).otherwise(q * (observed - predicted))


def histogram_frame(low: Column, high: Column) -> dict[str, Column]:
    """Bin layout from the 0.5 % and 99.5 % quantiles."""
    lo = F.greatest(F.floor(low).cast("int"), F.lit(-20))
    hi = F.greatest(F.least(F.ceil(high).cast("int"), F.lit(180)), lo + 6)
    width = F.when(hi - lo <= 30, 1).when(hi - lo <= 75, 2).otherwise(5)
    return {"lo": lo, "hi": hi, "width": width, "first": (F.floor(lo / width) * width).cast("int")}


def histogram_bins(quantile_table: DataFrame, keys: list[str]) -> DataFrame:
    """Bins of each distribution, given columns ``low`` and ``high``."""
    frame = histogram_frame(F.col("low"), F.col("high"))
    laid = quantile_table.select(*keys, *[c.alias(n) for n, c in frame.items()])
    return laid.withColumn("bin", F.explode(F.expr("sequence(first, hi - 1, width)")))


def histogram(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mass per bin over the central 99 %; a bin holds values in ``(bin, bin + width]``."""
    sums = summed(points, keys)
    bins = histogram_bins(quantiles(sums, keys, {"low": 0.005, "high": 0.995}), keys)
    layout = bins.select(*keys, "first", "width").distinct()
    totals = sums.groupBy(*keys).agg(F.sum("weight").alias("total"))
    start = F.col("first") + (F.ceil((F.col("value") - F.col("first")) / F.col("width")) - 1) * F.col("width")
    mass = (
        sums.join(layout, keys)
        .withColumn("bin", start.cast("int"))
        .groupBy(*keys, "bin")
        .agg(F.sum("weight").alias("mass"))
    )
    return (
        bins.join(totals, keys)
        .join(mass, [*keys, "bin"], "left")
        .select(*keys, "bin", "width", (F.coalesce("mass", F.lit(0.0)) / F.col("total")).alias("share"))
    )
