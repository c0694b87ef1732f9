"""Which data tiers to reload, and where the data in use comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stale_partitions(available: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Available partitions whose version was not processed yet."""
    return available.join(processed.select(*keys).distinct(), keys, "left_anti")


def stale_tiers(remote: DataFrame, base: DataFrame, recent: DataFrame, bundled: DataFrame) -> DataFrame:
    """One row: does the base or the recent tier differ from the remote build?

    Every input is a metadata table of at most one row.
    """
    local_base = F.coalesce(base.select("generated").scalar(), bundled.select("generated").scalar())
    local_recent = recent.select("recent_through").scalar()
    generated, through = F.col("generated"), F.col("recent_through")
    return remote.select(
        (generated.isNotNull() & ~generated.eqNullSafe(local_base)).alias("base_stale"),
        (through.isNotNull() & ~through.eqNullSafe(local_recent)).alias("recent_stale"),
    )


def meta_in_use(base: DataFrame, recent: DataFrame, bundled: DataFrame) -> DataFrame:
    """Provenance of the tiers in use: a downloaded base goes before the bundled one."""
    tagged = base.withColumn("downloaded", F.lit(True)).unionByName(bundled.withColumn("downloaded", F.lit(False)))
    best = tagged.agg(F.max_by(F.struct("generated", "trains", "downloaded"), "downloaded").alias("m"))
    through = recent.agg(F.max("recent_through").alias("through"), F.count("*").alias("n"))
    return (
        best.filter(F.col("m").isNotNull())
        .select(
            F.col("m.generated").alias("base_generated"),
            through.select("through").scalar().alias("recent_through"),
            F.col("m.trains").try_cast("int").alias("trains"),
            (F.col("m.downloaded") | (through.select("n").scalar() > 0)).alias("updated"),
        )
    )
