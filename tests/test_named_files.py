"""A month of many rows is written by several tasks and still read under one name."""

from pyspark.sql import functions as F

from lagcast.sources import derived, tables


def test_large_names_are_split(spark, tmp_path):
    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"), F.when(F.col("id") < 50_000, "data-2024-01").otherwise("data-recent-2024-02-03").alias("name"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "512k")
    try:
        derived.write_named(rows.repartition(8), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    assert len(list(tmp_path.glob("data-2024-01.parquet/*.parquet"))) > 2
    read = tables.with_source_file(spark.read.parquet(f"{tmp_path}/*.parquet"))
    got = {tuple(r) for r in read.groupBy("source_file", "month", "recent_day").count().collect()}
    assert got == {("data-2024-01", "2024-01", None, 50_000), ("data-recent-2024-02-03", None, "2024-02-03", 10_000)}
