"""WARC archives: one gzip member per record, written and read sequentially.

The reader inflates bytes as they come (one decompressor per member), cuts records by
their Content-Length, and checks block and payload digests; it holds one block of
input and one record. Files are written by tasks under names of their own and count
only if they are in the manifest, so tasks that are repeated leave no double records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import table
from lagcast.session import materialize, shared_dir

VERSION, DATE, READ_BYTES = b"WARC/1.1", "2024-01-01T00:00:00Z", 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = re.compile(r"<urn:x-page:(-?\d+|none)>")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """A record of type response or revisit; a revisit keeps the HTTP head and the payload's digest and length, not the payload."""
    name = lambda n: f"<urn:x-page:{'none' if n is None else n}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": name(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": name(refers_to) if kind == "revisit" else None,
        "WARC-Payload-Digest": "sha1:" + digest(payload),
        "WARC-Block-Digest": "sha1:" + digest(block),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(blocks: Iterator[bytes]) -> Iterator[bytearray]:
    """The inflated gzip members of a stream, one after the other."""
    unpack, data = zlib.decompressobj(31), bytearray()
    begun = False
    for block in blocks:
        while block:
            begun = True
            data += unpack.decompress(block)
            block = unpack.unused_data
            if unpack.eof:
                yield data
                unpack, data, begun = zlib.decompressobj(31), bytearray(), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (lower-case names) and block of a record, framed by its Content-Length and checked against its digests."""
    head, found, rest = bytes(data).partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not found or not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length differs from Content-Length")
    payload = block.partition(b"\r\n\r\n")[2]
    for name, content in (("warc-block-digest", block), ("warc-payload-digest", payload)):
        # A revisit names the digest of a payload that it does not hold.
        if name in fields and not (name == "warc-payload-digest" and fields["warc-type"] == "revisit"):
            if fields[name] != "sha1:" + digest(content):
                raise ValueError(f"{name} differs")
    return fields, block


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html and `original`: the largest page_id of equal payloads of at least min_bytes (null for smaller ones).

    A null html is an empty payload. Only digests are grouped, so a group of copies is
    counted before it meets; the join deals out large groups (adaptive skew splitting).
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"))
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= min_bytes, F.sha1("html")))
    groups = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("page_id").alias("original"))
    return rows.join(groups, "key", "left").drop("key")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Write one record per page under `folder`; returns the manifest (path, records, bytes).

    Of equal payloads, the row with the largest page_id becomes a response, the others
    revisits; rows that repeat this page_id are responses, and so are all rows of a payload
    whose page_ids are all null. A task starts a new file at `file_bytes`.
    A table without rows gives no file.
    """

    def write(batches):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        out, made = None, []
        for batch in batches:
            for page_id, url, html, original in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "original")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{top}/{name}")
                    made.append([f"{folder}/{name}", 0, 0])
                kind = "response" if original is None or original == page_id else "revisit"
                data = member(record(kind, page_id, url, html.encode(), original))
                out.write(data)
                made[-1][1] += 1
                made[-1][2] += len(data)
                if made[-1][2] >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), x, strict=True)) for x in made], MANIFEST)

    jvm = pages.sparkSession.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    return materialize(with_revisits(pages, min_bytes).mapInArrow(write, "path string, records long, bytes long"))


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def read_warc(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives in column `path`: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload.

    Length and digest are those of the full payload, for a revisit as its record tells
    them; its payload is null. Other record types are passed over. A damaged archive fails.
    """

    def read(batches):
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
                rows, held = [], 0
                with store.open_input_stream(inner) as stream:
                    for data in members(iter(lambda s=stream: s.read(READ_BYTES), b"")):
                        fields, block = parse(data)
                        if fields["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        own, other = (RECORD_ID.fullmatch(fields.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
                        whole = fields["warc-type"] == "response"
                        rows.append(
                            {
                                "page_id": int(own[1]) if own and own[1] != "none" else None,
                                "url": fields.get("warc-target-uri"),
                                "record_type": fields["warc-type"],
                                "refers_to": int(other[1]) if other and other[1] != "none" else None,
                                "payload_bytes": len(payload) if whole else int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)[1]),
                                "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
                                "payload": payload if whole and payloads else None,
                            }
                        )
                        held += len(block)
                        if held > 8 << 20 or len(rows) >= 2000:
                            yield pa.RecordBatch.from_pylist(rows, RECORDS)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORDS)

    # A task per archive.
    archives = manifest.select("path")
    n = max(1, archives.count())
    return archives.repartition(n, "path").mapInArrow(
        read, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    pages = table(spark, sf_dir, "pages")
    manifest = write_warc(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH hashed AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS original FROM hashed)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (i // 4) AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM grouped
"""
