"""Packing of documents into sequences by shallow length combinations.

Documents are cut into whole windows and a remainder. Remainders are counted by length class
(a class is rounded up to a few tokens, so that the classes are few at any size of the
corpus). Non-negative least squares over all combinations of at most three classes that
fill a window exactly finds how often to repeat each against this histogram; the counts are
rounded within what there is, and what is left is packed greedily, largest first. The plan
concerns classes only. Pieces then find their place by their rank in their class, and go there once.
"""

from __future__ import annotations

import uuid
import zlib
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagcast.llm.common import SLICE, row_slices, table
from lagcast.llm.tokens import encoder
from lagcast.session import materialize, shared_dir

WINDOW, STEP, END, PAD = 2048, 8, 1, 0
PIECE = "doc_id long, piece_start long, length long, doc_tokens long, class long, part long, nth long"
#: Rows of the table of (part, class) up to which it is sent to every task; beyond, pieces are joined by a shuffle.
BROADCAST_ROWS = 500_000


def stored_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, step: int = STEP, end: int = END) -> DataFrame:
    """Pieces of all documents (null text: the end id alone), tokenized and stored once: columns of PIECE and ids.

    `nth` numbers the pieces of a class within the part of the table that holds them. Ids are little-endian
    numbers of 2 bytes, or of 4 where a piece has a larger one.
    """

    def cut(batches):
        seen = np.zeros(window // step + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            for first, texts in row_slices(batch.column("text"), 4 * SLICE):
                ids, offsets = encoder(tokenizer).column(texts, end)
                counts = np.diff(offsets)
                n = -(-counts // window)
                row = np.repeat(np.arange(len(counts)), n)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * window
                length = np.minimum(counts[row] - start, window)
                low = offsets[:-1][row] + start
                kind = -(-length // step)
                order = np.argsort(kind, kind="stable")
                _, begins, many = np.unique(kind[order], return_index=True, return_counts=True)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(begins, many)
                nth += seen[kind]
                seen += np.bincount(kind, minlength=len(seen))
                packed = [ids[i : i + k].astype("<u2" if ids[i : i + k].max() < 1 << 16 else "<u4").tobytes() for i, k in zip(low.tolist(), length.tolist(), strict=True)]
                numbers = (start, length, counts[row], kind, np.full(len(row), part), nth)
                columns = [batch.column("doc_id").take(pa.array(first + row)), *(pa.array(x, pa.int64()) for x in numbers), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECE.split(", ")] + ["ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/pieces-{uuid.uuid4().hex}"
    made = rows.mapInArrow(cut, PIECE + ", ids binary")
    made.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(made.schema).parquet(path)


#: Columns that enter the active set at once, and the most rounds of doing so; what a plan leaves is packed greedily.
ENTER, ROUNDS = 24, 120


def least_squares(parts: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Non-negative least squares by active sets: column j of the matrix counts the classes in parts[j] (0 for none).

    Columns of the largest gradient enter, columns that turn negative leave. At most as many columns
    as rows keep a weight, so that rounding loses little.
    """
    x = np.zeros(len(parts))
    at = np.zeros(0, np.int64)

    def matrix(columns: np.ndarray) -> np.ndarray:
        made = np.zeros((len(goal) + 1, len(columns)))
        np.add.at(made, (parts[columns].ravel(), np.repeat(np.arange(len(columns)), parts.shape[1])), 1)
        return made[1:]

    rest = goal.astype(float)
    for _ in range(ROUNDS):
        gradient = np.append(0.0, rest)[parts].sum(1)
        gradient[at] = -np.inf
        enter = np.argsort(-gradient, kind="stable")[:ENTER]
        enter = enter[gradient[enter] > 1e-6 * max(1.0, goal.max())]
        if not len(enter):
            break
        at = np.concatenate((at, enter))
        while True:
            chosen = matrix(at)
            fit = np.linalg.solve(chosen.T @ chosen + 1e-9 * np.eye(len(at)), chosen.T @ goal)
            if fit.min() > 0:
                break
            low = fit <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - fit[low], 1e-300))
            moved = x[at] + step * (fit - x[at])
            leave = low & (moved <= 1e-9)
            x[at] = np.where(leave, 0.0, moved)
            at = at[~leave]
        x[at] = fit
        rest = goal - chosen @ fit
    return x


def plan(histogram: dict[int, int], classes: int) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of classes (summing to at most `classes`) and how many sequences take each; every piece is placed."""
    left = np.zeros(classes + 1, np.int64)
    for k, n in histogram.items():
        left[k] = n
    there = [k for k in range(1, classes + 1) if left[k]]
    present = set(there)
    shallow = [(classes,)] if classes in present else []
    shallow += [(classes - a, a) for a in there if 2 * a <= classes and classes - a in present]
    shallow += [(classes - a - b, b, a) for a, b in combinations_with_replacement(there, 2) if classes - a - b >= b and classes - a - b in present]
    made: list[tuple[tuple[int, ...], int]] = []
    if shallow:
        parts = np.array([(*combination, 0, 0)[:3] for combination in shallow])
        repeats = least_squares(parts, left[1:])
        for j in np.argsort(-repeats, kind="stable"):
            used = np.bincount(shallow[j], minlength=classes + 1)[1:]
            n = min(int(repeats[j] + 0.5), int((left[1:][used > 0] // used[used > 0]).min()))
            if n > 0:
                left[1:] -= n * used
                made.append((shallow[j], n))
    while left.any():
        room, combination, free = classes, [], left.copy()
        while True:
            fits = np.flatnonzero(free[: room + 1])
            if not len(fits):
                break
            k = int(fits[-1])
            many = min(int(free[k]), room // k)
            combination += [k] * many
            free[k] -= many
            room -= many * k
        used = np.bincount(combination, minlength=classes + 1)
        n = int((left[used > 0] // used[used > 0]).min())
        left -= n * used
        made.append((tuple(combination), n))
    return made


def places(made: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Runs of ranks over all pieces in the order of class: from which rank, how many per sequence, first sequence, slot."""
    runs, sequence = [], 0
    for combination, n in made:
        for k in sorted(set(combination)):
            runs.append((k, n, combination.count(k), sequence, combination.index(k)))
        sequence += n
    runs.sort(key=lambda r: r[0])
    low = np.cumsum([0] + [n * many for _, n, many, _, _ in runs])[:-1]
    _, _, many, first, slot = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 5
    return {"low": low, "many": many, "first": first, "slot": slot}


def placed(cut: DataFrame, window: int = WINDOW, step: int = STEP) -> DataFrame:
    """The pieces with sequence_id and slot: the plan of its class and its rank in the class say where a piece goes.

    Ranks need no sort of the pieces: a part counts its own, and sums over the parts of a class go before them.
    """
    classes = window // step
    counts = materialize(cut.groupBy("part", "class").agg(F.count(F.lit(1)).alias("many")))
    # At most `classes` rows come back.
    histogram = {r["class"]: r["many"] for r in counts.groupBy("class").agg(F.sum("many").alias("many")).collect()}
    runs = places(plan(histogram, classes))
    below = {k: sum(n for other, n in histogram.items() if other < k) for k in histogram}
    first = F.create_map(*[F.lit(x) for pair in sorted(below.items()) for x in pair]) if below else F.create_map(F.lit(0), F.lit(0))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "class", (first[F.col("class")] + F.coalesce(F.sum("many").over(before), F.lit(0))).alias("base"))
    if counts.count() <= BROADCAST_ROWS:
        base = F.broadcast(base)

    @F.arrow_udf("long")
    def place(index: pa.Array) -> pa.Array:
        index = index.to_numpy()
        run = np.searchsorted(runs["low"], index, "right") - 1
        beside, many = index - runs["low"][run], runs["many"][run]
        return pa.array((runs["first"][run] + beside // many) * window + runs["slot"][run] + beside % many, pa.int64())

    found = cut.join(base, ["part", "class"]).withColumn("place", place(F.col("base") + F.col("nth")))
    return found.withColumns({"sequence_id": F.floor(F.col("place") / window), "slot": F.pmod("place", F.lit(window))})


LAID = pa.struct([(c, pa.int64()) for c in ("doc_id", "start", "length", "doc_tokens", "offset")])
SEQUENCE = "sequence_id long, ids array<int>, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long, offset: long>>"


def write_sequences(docs: DataFrame, path: str, tokenizer: str, window: int = WINDOW, step: int = STEP, end: int = END, pad: int = PAD) -> None:
    """Packs all documents and writes the sequences as Parquet: sequence_id, ids (padded, except at a power of two), pieces.

    A null or empty text has the end id alone. Rows with a repeated or null doc_id are rows of their own; extra
    columns are left out; no rows give no sequences. Very long texts become many pieces; a text's own ids
    are held at once.
    """
    laid = placed(stored_pieces(docs, tokenizer, window, step, end), window, step)
    both = laid.select("sequence_id", "slot", "doc_id", "piece_start", "length", "doc_tokens", "ids")

    def lay(batches):
        now, ids, pieces, size = None, [], [], 0

        def finished():
            return now, pieces, np.concatenate([*ids, np.full(0 if size & (size - 1) == 0 else window - size, pad, np.int32)])

        def batch_of(made):
            ends = np.cumsum([0, *(len(m[2]) for m in made)]).astype(np.int32)
            values = np.concatenate([m[2] for m in made]) if made else np.zeros(0, np.int32)
            columns = [pa.array([m[0] for m in made], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array([m[1] for m in made], pa.list_(LAID))]
            return pa.RecordBatch.from_arrays(columns, ["sequence_id", "ids", "pieces"])

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row["sequence_id"] != now:
                    if now is not None:
                        made.append(finished())
                    now, ids, pieces, size = row["sequence_id"], [], [], 0
                n = row["length"]
                ids.append(np.frombuffer(row["ids"], "<u2" if len(row["ids"]) == 2 * n else "<u4").astype(np.int32))
                pieces.append({"doc_id": row["doc_id"], "start": row["piece_start"], "length": n, "doc_tokens": row["doc_tokens"], "offset": size})
                size += n
            yield batch_of(made)
        if now is not None:
            yield batch_of([finished()])

    # A sequence holds at most `window` ids.
    dealt = both.repartition("sequence_id").sortWithinPartitions("sequence_id", "slot")
    dealt.mapInArrow(lay, SEQUENCE).write.option("compression", "zstd").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEQUENCE).parquet(path)


def piece_digests(sequences: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32 (of the ids found in the sequence, as little-endian 32-bit numbers), doc_tokens, sequence_id, offset."""

    def digest(batches):
        for batch in batches:
            lists, inside = batch.column("ids"), batch.column("pieces")
            base = lists.offsets.to_numpy()[:-1]
            row = inside.value_parent_indices().to_numpy()
            laid = inside.flatten()
            doc_id, start, length, doc_tokens, offset = (laid.field(laid.type.get_field_index(c)) for c in ("doc_id", "start", "length", "doc_tokens", "offset"))
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            low = base[row] + offset.to_numpy()
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(low.tolist(), length.to_pylist(), strict=True)]
            columns = [doc_id, start, length, pa.array(crc, pa.int64()), doc_tokens, batch.column("sequence_id").take(pa.array(row)), offset]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return sequences.mapInArrow(digest, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """The pieces of all documents as they are read back from the sequences, which are written to the shared folder."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/sequences-{uuid.uuid4().hex}"
    write_sequences(docs, path, tokenizer, **settings)
    return piece_digests(read_sequences(spark, path))


def op9_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens, written and read back."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
