"""Daily overlay of recent days on the base history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagcast.operators.history import overlay_recent
from lagcast.streaming.partials import new_folder


def overlay_stream(recent: DataFrame, base: DataFrame, to_runs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Base history with the days of a stream laid over it.

    ``to_runs`` makes the runs of a micro-batch, previous delays included.  A trigger
    replaces the days it brings: what an earlier one said about them no longer counts.
    The overlay with the base happens on read and so never rewrites the base.
    """
    spark = recent.sparkSession
    folder = new_folder(spark, "overlay")

    def save(batch: DataFrame, batch_id: int) -> None:
        to_runs(batch).write.mode("overwrite").parquet(f"{folder}/data/batch={batch_id}")

    # A stream without a batch lays over nothing.
    base.limit(0).write.parquet(f"{folder}/data/batch=-1")
    query = (
        recent.writeStream.option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    tier = spark.read.option("mergeSchema", "false").parquet(f"{folder}/data")
    newest = tier.groupBy("day").agg(F.max("batch").alias("batch"))
    current = tier.join(newest, ["day", "batch"], "left_semi")
    return overlay_recent(base, current.select(base.columns))
