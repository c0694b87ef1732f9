"""Token ids of documents as ORC files.

ORC stores the ids with its integer run-length encoding, keeps minima and maxima per
stripe and row group (row index), and here a Bloom filter on `doc_id`. Files, and rows in
them, ascend by document, so that a lookup by id touches few stripes, and stripes are
read in parallel.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import prepared, running, table
from lagcast.llm.tokens import encoder
from lagcast.session import shared_dir

END = 1


def encode_rows(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """doc_id and `ids` (array of int) of every row, the id `end` last; a null text has the end id alone."""

    def encode(batches):
        for batch in batches:
            ids, offsets = encoder(tokenizer).column(batch.column("text"), end)
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.mapInArrow(encode, "doc_id long, ids array<int>")


def write_orc(docs: DataFrame, path: str, tokenizer: str, end: int = END, stripe_bytes: int = 64 << 20) -> None:
    """Write the ids of all documents in ascending doc_id (null first), rows of one doc_id by their text.

    Rows with a repeated doc_id stay rows of their own; extra columns are left out.
    A table without rows gives files without rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    (
        encode_rows(ordered, tokenizer, end)
        .write.option("orc.compress", "ZSTD")
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.row.index.stride", "1000")
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .mode("errorifexists")
        .orc(path)
    )


def read_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id and ids; with doc_ids, only stripes and row groups that may hold one of them are read."""
    rows = prepared(spark).read.schema("doc_id long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start (ids of all rows before it), n_tokens, ids_crc32 (of little-endian 32-bit ids)."""

    def crc(batches):
        for batch in batches:
            lists = batch.column("ids")
            values = np.frombuffer(lists.values.buffers()[1], "<u4")[lists.values.offset :] if len(lists.values) else np.zeros(0, "<u4")
            ends = lists.offsets.to_numpy()
            raw = memoryview(values).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], ["doc_id", "n_tokens", "ids_crc32"]
            )

    made = rows.mapInArrow(crc, "doc_id long, n_tokens long, ids_crc32 long")
    # Rows alike in all columns are alike, so any order among them gives the same result.
    order = [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("ids_crc32")]
    return running(made, order, "n_tokens").select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as ORC in the shared folder and read back."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/orc-{uuid.uuid4().hex}"
    write_orc(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return digests(read_orc(spark, path))
