"""Shared pieces of the operators: tables, distributed running sums, hashing of words in Arrow columns."""

from __future__ import annotations

import hashlib
import sys
import types

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagcast.session import configure, materialize

#: Rows and bytes of one Arrow batch sent to a Python worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators count on."""
    configure(spark)
    for key, value in BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def worker_state() -> dict:
    """A dictionary that lives as long as a Python worker: tokenizers and their word caches."""
    name = "_lagcast_worker_state"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def forget(name: str) -> None:
    """Give up something kept by the worker, and the memory it took: workers are reused by later stages."""
    if worker_state().pop(name, None) is None:
        return
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Other C libraries give memory back by themselves.
        pass


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def running(df: DataFrame, order: list[Column], size: str) -> DataFrame:
    """Adds `index` (gapless from 0) and `start` (sum of `size` before the row) over one global order.

    The rows are dealt by range and sorted, and stored once. Each part then gets the
    counts and sums of the parts before it, so only one small row per part meets
    in one place. Rows equal in all of `order` must be interchangeable.
    """
    stored = materialize(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of the number are the part, the lower 33 the place in it.
    stored = stored.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(size).alias("_s"))
        .select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_s")))
    )
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        stored.withColumn("_before", F.coalesce(F.sum(size).over(within), F.lit(0)))
        .join(parts, "_part")
        .withColumn("index", F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn("start", F.col("_s") + F.col("_before"))
        .drop("_at", "_part", "_before", "_n", "_s")
    )


# ---------------------------------------------------------------- words of an Arrow column

MULTIPLIER = 0x9E3779B97F4A7C15
BLOCK = 1 << 19
#: Sums of powers modulo 2**64 collide on regular strings from about 1024 bytes; words above this are digested.
LONG = 64
#: Bytes of text that a worker holds arrays of at once.
SLICE = 1 << 20
#: Byte classes: 0 white space (space, and tab to carriage return), 2 ASCII punctuation, 1 the rest.
CLASSES = np.ones(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] = 0
PUNCTUATED = CLASSES.copy()
PUNCTUATED[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def digest64(data: bytes) -> int:
    """A hash without structure, for what is too long for sums of powers."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least n of each."""
    state = worker_state()
    if len(state.get("powers", ((),))[0]) < n:
        n = max(n, 2 * BLOCK)
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        state["powers"] = tuple(
            np.concatenate(([np.uint64(1)], np.cumprod(np.full(n - 1, m, np.uint64)))) for m in (MULTIPLIER, inverse)
        )
    return state["powers"]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; nulls are empty."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def row_slices(column, size: int = SLICE):
    """First row and part of consecutive parts of a column of texts, each of about `size` bytes or one longer row."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, column.slice(at, to - at)
        at = to


def word_hashes(column, letters: np.ndarray = LOWER, classes: np.ndarray = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a column, and for each row where its words begin (one more at the end).

    A word is a longest run of bytes of one class other than 0 within a row. A word's
    hash is a difference of two running sums, so a block takes a few array operations.
    Longer words, for which a sum modulo a power of two is weak, are hashed one by one. Blocks end
    between runs, so that memory does not grow with the text.
    """
    forget("encoders")
    data, offsets = utf8(column)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets[(offsets >= offsets[0]) & (offsets <= offsets[-1])]] = True
    hashes, begins = [], []
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        to = min(at + BLOCK, last)
        kind = classes[data[at:to]]
        change = np.empty(to - at + 1, bool)
        change[0] = change[-1] = True
        change[1:-1] = (kind[1:] != kind[:-1]) | edge[at + 1 : to]
        cuts = np.flatnonzero(change)
        if to < last and len(cuts) > 2:
            # The last run may go on.
            cuts = cuts[:-1]
            to = at + int(cuts[-1])
        while to < last and len(cuts) == 2:
            # One run, longer than a block.
            on = min(to + BLOCK, last)
            step = np.flatnonzero((classes[data[to:on]] != kind[0]) | edge[to:on])
            to = to + int(step[0]) if len(step) else on
            cuts[1] = to - at
            if len(step):
                break
        keep = kind[cuts[:-1]] != 0
        starts, ends = cuts[:-1][keep], cuts[1:][keep]
        made = np.zeros(len(starts), np.uint64)
        if to - at <= BLOCK:
            up, down = powers(to - at)
            sums = np.zeros(to - at + 1, np.uint64)
            np.cumsum((letters[data[at:to]].astype(np.uint64) + np.uint64(1)) * up[: to - at], out=sums[1:])
            made = mix((sums[ends] - sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > LONG):
            made[i] = digest64(letters[data[at + int(starts[i]) : at + int(ends[i])]].tobytes())
        hashes.append(made)
        begins.append(starts + at)
        at = to
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    begins = np.concatenate(begins) if begins else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begins, offsets)
