"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot key is split even where that costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs count on to a session made elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lagcast")
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; a local one only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate with several consumers as a table in the shared folder.

    Used where a table is small against its inputs but read by many branches.
    The files survive the loss of executors; being Parquet, they keep column
    pruning, filter pushdown and the size on which joins are planned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, folder: str):
    """The file system of a folder and its constructor of paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def generations(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the committed generations of a table, ascending."""
    fs, path = file_system(spark, folder)
    if not fs.exists(path(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path(folder))]
    return sorted(int(n.removeprefix("generation=")) for n in names if n.startswith("generation="))


def stored_table(spark: SparkSession, name: str, version: str, build: Callable[[], DataFrame], keys: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """A table of the catalog that is written once per version of its inputs, bucketed and sorted by its keys if it has any.

    Readers that group or join by the keys need no shuffle of it.  ``buckets`` defaults to the
    session's shuffle partitions, so that the other side of a join is dealt alike.
    """
    table = f"lagcast_{name}_{version}"
    if not spark.catalog.tableExists(table):
        made = build()
        if keys:
            n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            writer = made.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).sortBy(*keys)
        else:
            writer = made.write.format("parquet")
        writer.option("path", f"{shared_dir(spark)}/{table}-{uuid.uuid4().hex}").saveAsTable(table)
    return spark.table(table)
