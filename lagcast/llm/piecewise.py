"""Context-triggered piecewise hashing of whole texts.

A hash rolls over the last seven bytes; where it hits the block size, a chunk ends, and
each chunk gives one of 64 characters. A fingerprint is `block:chunks:chunks at twice the
block`. The block size is the smallest of 3, 6, 12, ... at which a text has at most 64
chunks, so no text is cut off. Fingerprints of block sizes at most one step apart are
compared by edit distance (insertion and deletion 1, change 2) at the size they share.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagcast.llm.common import mix, powers, table
from lagcast.session import materialize

WINDOW, LEAST_BLOCK, CHUNKS = 7, 3, 64
#: Signatures must share so long a run of characters, or a third of the shorter one.
COMMON_RUN = 5
#: Characters of a chunk, in the order of their value.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprint(text: bytes) -> str:
    """The fingerprint of a whole text; equal texts have equal ones, the empty text `3::`."""
    n = len(text)
    if not n:
        return f"{LEAST_BLOCK}::"
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    # The hash of the bytes before each end, as if they began at place 0.
    first = np.maximum(np.arange(1, n + 1) - WINDOW, 0)
    rolled = mix((sums[1:] - sums[first]) * down[first])
    hits = np.flatnonzero(rolled % np.uint64(LEAST_BLOCK) == 0)
    # A hit stays one for as many doublings of the block as its quotient can be halved.
    quotient = rolled[hits] // np.uint64(LEAST_BLOCK)
    lowest = quotient & (~quotient + np.uint64(1))
    halvings = np.frexp(lowest.astype(np.float64))[1] - 1
    reach = np.bincount(np.maximum(halvings, 0), minlength=1)[::-1].cumsum()[::-1]
    level = int(np.count_nonzero(reach >= CHUNKS))

    def chunks(level: int) -> str:
        b = hits[halvings >= level] + 1
        if not len(b) or b[-1] != n:
            b = np.append(b, n)
        a = np.empty_like(b)
        a[0], a[1:] = 0, b[:-1]
        return ALPHABET[(mix((sums[b] - sums[a]) * down[a]) >> np.uint64(58)).astype(np.int64)].tobytes().decode()

    return f"{LEAST_BLOCK << level}:{chunks(level)}:{chunks(level + 1)}"


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, all cells of a row at once as bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def signature_likeness(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    # A text of a line has few chunks, and an edit in each third of it leaves no long run.
    run = max(1, min(COMMON_RUN, len(a) // 3, len(b) // 3))
    runs = {a[i : i + run] for i in range(len(a) - run + 1)}
    if not any(b[i : i + run] in runs for i in range(len(b) - run + 1)):
        return 0.0
    # One minus the edit distance over its largest value.
    return 2.0 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(one: str, other: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 for block sizes more than one step apart."""
    if one == other:
        return 1.0
    (block, a, a2), (block2, b, b2) = one.split(":"), other.split(":")
    pairs = {1: [(a, b), (a2, b2)], 2: [(a2, b)], 0.5: [(a, b2)]}.get(int(block2) / int(block), [])
    return max((signature_likeness(x, y) for x, y in pairs), default=0.0)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> dict:
    cut = len(text) // 3
    edited = (text[: len(text) - cut] + following[:cut]).encode()
    made = fingerprint(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited).hexdigest(),
        "fingerprint": own,
        "edited_fingerprint": made,
        "near_edited": likeness(own, made),
        "near_next": likeness(own, following_print),
    }


ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("edge", pa.string()),
        ("part", pa.int32()),
        ("text", pa.large_string()),
    ]
)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness; columns of RESULT.

    In the order of descending doc_id (null last; rows of one doc_id by a hash of their text),
    each document's last third is replaced by the first characters of the next document;
    after the last comes the first. A null text is empty. A lone document is next to itself.
    Extra columns are left out, repeated rows stay rows; no rows give no rows.

    The texts are dealt out once by range and each part is read in order. The last row of a part
    waits for the first row of the next: these two rows per part are joined afterwards.
    """
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def read(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last, out = None, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = fingerprint(text.encode())
                if last is None:
                    out.append({"edge": "first", "part": part, "text": text, "fingerprint": own})
                else:
                    out.append(compare(*last, text, own))
                last = (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(out, ROW)
            out = []
        if last is not None:
            doc_id, text, own = last
            yield pa.RecordBatch.from_pylist([{"doc_id": doc_id, "fingerprint": own, "edge": "last", "part": part, "text": text}], ROW)

    made = materialize(rows.orderBy(*order).mapInArrow(read, RESULT + ", edge string, part int, text string"))
    names = [c.split()[0] for c in RESULT.split(", ")]
    firsts = made.where("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    # One row per part without its text; the part after the last is the first.
    parts = made.where("edge = 'first'").select("part")
    following = parts.select(F.col("part").alias("at"), F.lead("part").over(Window.orderBy("part")).alias("part"))
    lowest = parts.agg(F.min("part")).scalar()
    following = following.withColumn("part", F.coalesce("part", lowest))
    pairs = (
        made.where("edge = 'last'")
        .select("doc_id", "text", "fingerprint", F.col("part").alias("at"))
        .join(following, "at")
        .join(firsts, "part")
        .select("doc_id", "text", "fingerprint", "next_text", "next_print")
    )

    def finish(batches):
        for batch in batches:
            found = [compare(*(r[c] for c in ("doc_id", "text", "fingerprint", "next_text", "next_print"))) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, pa.schema(list(ROW)[: len(names)]))

    return made.where("edge IS NULL").select(*names).unionByName(pairs.mapInArrow(finish, RESULT))


def op1_piecewise_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piecewise fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
