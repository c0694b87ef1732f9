"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.session import materialize


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Links every vertex to the least vertex next to it: larger ones around each vertex, or smaller ones and itself."""
    around = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))) if larger else edges
    least = around.groupBy(F.col("high").alias("centre")).agg(F.min("low").alias("least")).withColumn("least", F.least("centre", "least"))
    joined = around.join(least, around["high"] == least["centre"]).select("centre", F.col("low").alias("other"), "least")
    if larger:
        made = joined.where("other > centre").select(F.col("other").alias("high"), F.col("least").alias("low"))
    else:
        made = joined.select(F.col("other").alias("high"), F.col("least").alias("low")).unionByName(least.select(F.col("centre").alias("high"), F.col("least").alias("low")))
    return made.where("high > low").distinct()


def _done(edges: DataFrame) -> bool:
    """Every vertex has one lower one, and that has none."""
    several = edges.groupBy("high").agg(F.min("low").alias("low"), F.max("low").alias("most")).where("low <> most")
    chained = edges.join(edges.select(F.col("high").alias("low")).distinct(), "low", "left_semi")
    return several.isEmpty() and chained.isEmpty()


def components(links: DataFrame) -> DataFrame:
    """vertex, root (least vertex of its component) for all vertices of `links` (a, b); alternating large and small stars.

    Each round is two group-bys and joins, stored once; rounds grow with the logarithm of the largest component.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    while not _done(edges):
        edges = materialize(_stars(materialize(_stars(edges, True)), False))
    stars = edges.select(F.col("high").alias("vertex"), F.col("low").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("vertex"), "root").distinct())
