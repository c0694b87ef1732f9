"""Online bucket statistics and their snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.operators.bucket_model import BUCKET, bucket_stats
from lagcast.session import file_system, generations
from lagcast.streaming.partials import new_folder


def merge_stats(parts: DataFrame) -> DataFrame:
    """Combine statistics of disjoint observations, e.g. a snapshot and new ones."""
    n = F.sum("n")
    mean = F.sum(F.col("n") * F.col("mean")) / n
    power = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return parts.filter("n > 0").groupBy(*BUCKET).agg(
        n.alias("n"), mean.alias("mean"), (power - n * mean * mean).alias("m2")
    )


def commit_snapshot(stats: DataFrame, folder: str, generation: int) -> None:
    """Write a snapshot beside the others and give it its number by a rename; one that is there already stays."""
    target = f"{folder}/generation={generation}"
    temporary = f"{folder}/_writing-{uuid.uuid4().hex}"
    fs, path = file_system(stats.sparkSession, folder)
    if fs.exists(path(target)):
        return
    stats.coalesce(1).write.parquet(temporary)
    if not fs.rename(path(temporary), path(target)):
        raise OSError(f"cannot commit {target}")


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    found = generations(spark, folder)
    return spark.read.parquet(f"{folder}/generation={found[-1]}") if found else None


EMPTY = "train_class string, time_band string, n bigint, mean double, m2 double"


def bucket_stats_stream(observed: DataFrame, snapshot: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Statistics after draining a stream of observations, on top of a snapshot.

    The streaming state is one row per bucket (at most sixteen), kept and merged by Spark; every trigger commits
    a snapshot of its own.  With the folder of an earlier call, the stream goes on from its checkpoint, and
    the newest committed snapshot is found again even if nothing new arrives.
    """
    spark = observed.sparkSession
    folder = folder or new_folder(spark, "buckets")

    def save(batch: DataFrame, batch_id: int) -> None:
        commit_snapshot(batch, f"{folder}/snapshots", batch_id)
        # The one before stays for readers that have it open.
        fs, path = file_system(batch.sparkSession, folder)
        for old in generations(batch.sparkSession, f"{folder}/snapshots")[:-2]:
            fs.delete(path(f"{folder}/snapshots/generation={old}"), True)

    query = (
        bucket_stats(observed)
        .writeStream.outputMode("complete")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .foreachBatch(save)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    fresh = latest_snapshot(spark, f"{folder}/snapshots")
    if fresh is None:  # nothing ever arrived
        fresh = spark.createDataFrame([], EMPTY)
    return merge_stats(fresh if snapshot is None else fresh.unionByName(snapshot.select(fresh.columns)))
