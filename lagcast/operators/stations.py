"""Station lookup by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagcast import params as P
from lagcast.functions.text import normal_name

GRAM = 3


def _starts(name, size: int):
    last = F.length(name) - size + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substr(name, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def _name_grams(stations: DataFrame) -> DataFrame:
    """Every piece of one to three characters of a station name."""
    name = F.col("norm")
    pieces = F.array_distinct(F.concat(*[_starts(name, n) for n in range(1, GRAM + 1)]))
    return stations.withColumn("norm", normal_name(F.col("name"))).withColumn("gram", F.explode(pieces))


def resolve_stations(queries: DataFrame, stations: DataFrame, limit: int = 1) -> DataFrame:
    """Best stations for each ``text``: contained in the name, prefix first, then weight.

    A text of three or more characters can only be contained in a name that has
    its leading three characters, so an equi-join on such pieces replaces the
    comparison of every text with every station.
    """
    texts = queries.select("text").distinct().withColumn("q", normal_name(F.col("text")))
    grams = _name_grams(stations)
    hits = (
        texts.filter("q <> ''")
        .withColumn("gram", F.substring("q", 1, GRAM))
        .join(grams, "gram")
        .filter(F.contains("norm", F.col("q")))
        .withColumn("score", F.when(F.startswith("norm", F.col("q")), P.PREFIX_BONUS).otherwise(0) + F.col("weight"))
        .select("text", "eva", "name", "weight", "score")
    )
    # A blank text lists the most important stations.
    top = stations.select("eva", "name", "weight", F.col("weight").alias("score")).orderBy(
        F.desc("weight"), "eva"
    ).limit(limit)
    tops = top.agg(F.collect_list(F.struct("eva", "name", "weight", "score"))).scalar()
    listed = texts.filter("q = ''").withColumn("tops", tops).select("text", F.inline("tops"))
    best = Window.partitionBy("text").orderBy(F.desc("score"), "eva")
    return (
        hits.unionByName(listed)
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
    )


def resolve_column(df: DataFrame, column: str, stations: DataFrame, prefix: str) -> DataFrame:
    """Adds ``<prefix>_eva`` and ``<prefix>_name`` of the best match; null if none."""
    found = resolve_stations(df.select(F.col(column).alias("text")), stations).select(
        F.col("text").alias(column), F.col("eva").alias(f"{prefix}_eva"), F.col("name").alias(f"{prefix}_name")
    )
    return df.join(found, column, "left")


def stations_by_name(stations: DataFrame) -> DataFrame:
    """One station per normalised name."""
    return (
        stations.withColumn("norm", normal_name(F.col("name")))
        .groupBy("norm")
        .agg(F.max_by(F.struct("eva", "name", "weight"), F.struct("weight", "eva")).alias("s"))
        .select("norm", "s.*")
    )
