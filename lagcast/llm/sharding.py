"""Minimax contiguous partition: shards whose largest size is the least possible without splitting a group.

Atomic groups (equal texts) stand in the order of their key. The smallest feasible
capacity is found by binary search: a capacity is checked greedily, filling each shard
as far as it fits. Every greedy end lies in a narrow window of the running sums; while
the windows hold too many groups for the driver, rounds of distributed checks narrow them.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import running, table
from lagcast.session import materialize

#: Capacities checked side by side in a round of distributed checks, and the most running sums that come to the driver.
PROBES, WINDOW_ROWS = 32, 100_000


def group_sums(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Groups in the order of their key: `group_size`, `members`, `start` and `stop` (running sums of size), `first` (rows before)."""
    groups = rows.groupBy(key).agg(F.sum(size).alias("group_size"), F.count(F.lit(1)).alias("members"))
    placed = running(groups, [F.col(key)], "group_size").drop("index").withColumn("stop", F.col("start") + F.col("group_size"))
    return materialize(placed)


def walk(groups: DataFrame, shards: int, total: int, largest: int, capacities: list[int]) -> list[list[int]]:
    """Greedy ends of the shards for each capacity: a step of all walks is one aggregate over a band of the table."""
    ends = [[0] for _ in capacities]
    for _ in range(shards):
        goals = [e[-1] + c for e, c in zip(ends, capacities, strict=True)]
        # The end sought lies less than the largest group below the goal.
        band = groups.where(F.col("stop").between(min(goals) - largest, max(goals)))
        found = band.agg(*(F.max(F.when(F.col("stop") <= g, F.col("stop"))).alias(f"c{i}") for i, g in enumerate(goals))).first()
        ends = [e + [total if g >= total else e[-1] if x is None else x] for e, g, x in zip(ends, goals, found, strict=True)]
    return [e[1:] for e in ends]


def cut_points(groups: DataFrame, shards: int, window_rows: int = WINDOW_ROWS) -> tuple[int, list[int]]:
    """The smallest capacity with which `shards` contiguous shards hold all groups, and the running sums at their ends."""
    total, largest = groups.agg(F.coalesce(F.max("stop"), F.lit(0)), F.coalesce(F.max("group_size"), F.lit(0))).first()
    low = max(-(-total // shards), largest)
    # A shard that takes no further group lacks less than the largest group.
    high = max(low, -(-total // shards) + largest)
    windows = [(k * (low - largest), k * high) for k in range(1, shards + 1)]
    while True:
        inside = groups.where(reduce(lambda x, y: x | y, (F.col("stop").between(a, b) for a, b in windows))).select("stop")
        if low == high or inside.count() <= window_rows:
            break
        tried = sorted({low - 1, high, *range(low, high, max(1, (high - low) // PROBES))})
        ends = walk(groups, shards, total, largest, tried)
        done = next(i for i, e in enumerate(ends) if e[-1] == total)
        # Greedy ends grow with the capacity.
        windows = list(zip(ends[max(0, done - 1)], ends[done], strict=True))
        low, high = tried[done - 1] + 1 if done else tried[done], tried[done]
    if low == high:
        return low, walk(groups, shards, total, largest, [low])[0]
    stops = sorted(r[0] for r in inside.collect())

    def greedy(capacity: int) -> list[int]:
        ends = [0]
        for _ in range(shards):
            at = bisect_right(stops, ends[-1] + capacity)
            ends.append(max(ends[-1], stops[at - 1]) if at else ends[-1])
        return ends[1:]

    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if greedy(middle)[-1] == total else (middle + 1, high)
    return low, greedy(low)


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Shards of nearly equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard, group_key.

    Size is the UTF-8 bytes of the text plus 1; a null text counts as empty for the size, the
    checksum and the group. Rows of equal texts stay in one shard. `slot` numbers a shard's
    rows from 0 in the order of group, then doc_id (null first). Rows with a repeated or null
    doc_id are rows of their own. Extra columns are left out. Without rows the result is empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.sha2(text, 256).alias("group_key"),
    )
    rows = materialize(rows)
    groups = group_sums(rows, "group_key", "size")
    _, ends = cut_points(groups, shards)
    # The last key of every shard but the last; at most one row per shard comes back.
    inner = sorted({e for e in ends[:-1] if e > 0})
    keys = [r["group_key"] for r in groups.where(F.col("stop").isin(inner)).select("group_key").collect()]
    # Empty shards (more shards than groups) are left at the end.
    shard = sum(((F.col("group_key") > F.lit(k)).cast("int") for k in keys), F.lit(0))
    placed = running(rows.withColumn("shard", shard), [F.col("group_key"), F.col("doc_id"), F.col("size")], "size")
    firsts = placed.groupBy("shard").agg(F.min("index").alias("first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("index") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "group_key",
    )


def op2_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards of nearly equal bytes, by minimax contiguous partition."""
    return shard_by_bytes(table(spark, sf_dir, "documents"))
