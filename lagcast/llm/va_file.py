"""Exact nearest neighbours by inner product with a vector-approximation file.

Vectors are written in blocks; a block keeps, for every component, the lowest value and a
cell width, and per vector the number of the cell that holds the component. A query's
inner product with a vector lies within a fixed distance of that with the cell's middle.
The approximations are scanned first: a vector stays if its upper bound reaches the k-th
best lower bound. The exact vectors of those are then read in the order of upper bound,
first the k best, then all whose bound reaches the k-th score found: the result is certain.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagcast.llm.common import table
from lagcast.session import materialize

#: Bits of a cell number; vectors per block; queries per block.
BITS, BLOCK_ROWS, QUERY_ROWS = 6, 2048, 1024
SCALE = 256


def quantised(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id, vector (array of long, floor(256 * x)), dim of every row that takes part.

    Rows without vec_id and vectors that are null, empty or hold null or non-finite components are left out, and such
    with a component of 2**46 or more, whose cells no double tells apart. Repeated rows and different vectors with
    one vec_id are rows of their own.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float(1 << 46)))
    known = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * SCALE))
    return known.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("vector"), F.size(x).alias("dim"))


def candidates(exact: DataFrame, k: int) -> DataFrame:
    """The k + 1 rows with the smallest ids of each distinct vector: others of it can't be among the k best of any query."""
    same = Window.partitionBy("vector").orderBy("vec_id", "row")
    return exact.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= k + 1).drop("nth")


def va_file(exact: DataFrame) -> DataFrame:
    """Blocks of approximations: dim, ids, low and width (per component), cells (one byte per component and vector)."""

    def encode(batches):
        for batch in batches:
            dims, ids, vectors = batch.column("dim").to_numpy(), batch.column("row").to_numpy(), batch.column("vector")
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for part in np.array_split(rows, -(-len(rows) // BLOCK_ROWS)):
                    values = vectors.take(pa.array(part)).flatten().to_numpy().reshape(len(part), dim)
                    low = values.min(0)
                    width = (values.max(0) - low) // (1 << BITS) + 1
                    yield pa.RecordBatch.from_pylist(
                        [{"dim": int(dim), "ids": ids[part].tobytes(), "low": low.tobytes(), "width": width.tobytes(), "cells": ((values - low) // width).astype(np.uint8).tobytes()}], BLOCK
                    )

    return materialize(exact.select("dim", "row", "vector").mapInArrow(encode, "dim int, ids binary, low binary, width binary, cells binary"))


BLOCK = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "low", "width", "cells"))])


def query_blocks(queries: DataFrame) -> tuple[DataFrame, int]:
    """Queries by (dim, query_block), about QUERY_ROWS each, and the number of blocks."""
    n = max(1, -(-queries.count() // QUERY_ROWS))
    numbered = queries.withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
    gathered = numbered.groupBy("dim", "query_block").agg(F.collect_list(F.struct("row", "vector")).alias("queries"))
    return gathered, n


def scan(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_row, row, lower, upper: for each query, in each task, what may be among its k best.

    Each block of approximations meets each block of queries of its dimension, not each vector each query.
    """
    gathered, n = query_blocks(queries)
    dealt = blocks.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pairs = dealt.join(gathered, ["dim", "query_block"]).sortWithinPartitions("dim", "query_block")

    def bound(batches):
        held: dict = {}

        def out(held):
            for q, (ids, low, high) in zip(held["ids"], held["found"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), pa.array(ids), pa.array(low), pa.array(high)], ["query_row", "row", "lower", "upper"])

        for batch in batches:
            for i in range(batch.num_rows):
                name = (batch.column("dim")[i].as_py(), batch.column("query_block")[i].as_py())
                if held.get("name") != name:
                    if held:
                        yield from out(held)
                    rows = batch.column("queries")[i].values
                    dim = name[0]
                    held = {"name": name, "ids": rows.field("row").to_numpy(), "q": rows.field("vector").flatten().to_numpy().reshape(-1, dim).astype(np.float64)}
                    held["found"] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(held["ids"])
                ids, low, width = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "low", "width"))
                cells = np.frombuffer(batch.column("cells")[i].as_py(), np.uint8).reshape(len(ids), -1)
                middle = low + cells * width.astype(np.float64) + (width - 1) / 2
                near = held["q"] @ middle.T
                # Half a cell in each component, and what rounding may add.
                off = np.abs(held["q"]) @ ((width - 1) / 2 + 1e-12 * np.abs(middle).max(0, initial=0.0)) + 1.0
                top = min(k + 1, len(ids))
                least = np.partition(near, len(ids) - top, axis=1)[:, len(ids) - top] - 2 * off
                for r, (q, floor) in enumerate(zip(held["ids"], least, strict=True)):
                    old = held["found"][r]
                    # One more than k, as the query itself may be among them.
                    if len(old[0]) > k:
                        floor = max(floor, np.partition(old[1], len(old[1]) - k)[len(old[1]) - k] - off[r])
                    fit = np.flatnonzero(near[r] >= floor)
                    fit = fit[ids[fit] != q]
                    if not len(fit):
                        continue
                    new = (np.concatenate((old[0], ids[fit])), np.concatenate((old[1], near[r][fit] - off[r])), np.concatenate((old[2], near[r][fit] + off[r])))
                    if len(new[0]) > k:
                        tau = np.partition(new[1], len(new[1]) - k)[len(new[1]) - k]
                        stay = new[2] >= tau
                        new = tuple(x[stay] for x in new)
                    held["found"][r] = new
        if held:
            yield from out(held)

    return pairs.mapInArrow(bound, "query_row long, row long, lower double, upper double")


def scores(pairs: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact integer inner products of (query_row, row) pairs, read from the exact vectors; decimals hold what a long may not."""
    v = exact.select("row", "vec_id", F.col("vector").alias("v"))
    q = exact.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    largest = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: F.greatest(s, F.abs(x)))
    product = F.aggregate(F.zip_with("q", "v", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, x: s + x).cast("decimal(38,0)")
    wide = F.aggregate(
        F.zip_with("q", "v", lambda a, b: a.cast("decimal(18,0)") * b.cast("decimal(18,0)")), F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x).cast("decimal(38,0)")
    )
    fits = largest("q").cast("double") * largest("v").cast("double") * F.size("q") < float(1 << 62)
    return pairs.join(v, "row").join(q, "query_row").select("query_row", "query_id", "row", "vec_id", F.when(fits, product).otherwise(wide).alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query row with all other rows of its dimension.

    Ties go to the smaller vec_id; a query with fewer other rows gets all. Vectors are as `quantised` says; a
    score beyond a long ranks by its value and is null.
    """
    exact = materialize(quantised(vectors))
    blocks = va_file(candidates(exact, k))
    bounds = materialize(scan(blocks, exact.where(is_query), k))
    # Per query a few rows of each task are left.
    by_lower = Window.partitionBy("query_row").orderBy(F.col("lower").desc())
    ranked = bounds.withColumn("at", F.row_number().over(by_lower))
    floor = F.min(F.when(F.col("at") <= k, F.col("lower"))).over(Window.partitionBy("query_row"))
    stay = ranked.withColumn("floor", floor).where(F.col("upper") >= F.col("floor"))
    by_upper = Window.partitionBy("query_row").orderBy(F.col("upper").desc(), "row")
    stay = materialize(stay.select("query_row", "row", "upper", F.row_number().over(by_upper).alias("at")))
    first = materialize(scores(stay.where(F.col("at") <= k).select("query_row", "row"), exact))
    kth = first.groupBy("query_row").agg(F.min("score").alias("kth"))
    # What may still reach the k-th score; a query with k candidates or fewer has none left.
    rest = stay.where(F.col("at") > k).join(kth, "query_row").where(F.col("upper") >= F.col("kth").cast("double")).select("query_row", "row")
    every = first.unionByName(scores(rest, exact))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    found = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))


def op3_va_file_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best neighbours of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
