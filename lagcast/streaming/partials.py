"""Incremental folds kept as partial results per micro-batch.

The folds of this package are associative (first, last-per-attribute, moments),
so a micro-batch writes only the fold of its own rows and a reader folds the
partial results again.  No operator state grows with the keys, no row is late,
and a replayed batch overwrites its own folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lagcast.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_partials(
    stream: DataFrame, fold: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Start a query that folds every micro-batch into ``path/batch=<id>``."""

    def save(batch: DataFrame, batch_id: int) -> None:
        fold(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_partials(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def compact(spark: SparkSession, path: str, refold: Callable[[DataFrame], DataFrame], target: str) -> None:
    """Fold the partial results so far into one new table."""
    refold(read_partials(spark, path)).write.mode("overwrite").parquet(target)


def run_fold(
    stream: DataFrame,
    fold: Callable[[DataFrame], DataFrame],
    refold: Callable[[DataFrame], DataFrame],
    name: str,
) -> DataFrame:
    """Drain the available input of a stream and return its current fold."""
    spark = stream.sparkSession
    path = new_folder(spark, name)
    # A stream without a batch has the fold of no rows.
    fold(spark.createDataFrame([], stream.schema)).write.parquet(f"{path}/data/batch=-1")
    query = write_partials(stream, fold, f"{path}/data", f"{path}/checkpoint")
    query.awaitTermination()
    return refold(read_partials(spark, f"{path}/data"))
