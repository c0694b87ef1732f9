"""Chat formatting into a prefix tree.

Conversations that share their first turns share a path. A turn is known by the digest of
all turns up to it; the digests of the turns above, one after another, are its path. Equal
paths merge, and the sorted paths are the tree in depth-first order, so each shared turn is
emitted once and a large tree spreads over many tasks. Each turn's row says where it stands
in that stream, at which position of its conversation it begins, and which stretches of the
stream it may attend to: itself and its ancestors.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import running, table
from lagcast.session import materialize, shared_dir

#: The template's control strings; marks of a user's, an assistant's and any other turn.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
#: A control string inside a text gets a backslash after its bracket, one more if it had some.
ESCAPE = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|/?ROLE\])")
UNESCAPE = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|/?ROLE\])")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's string, and the span of its text under the loss mask (of an assistant's turn, else empty)."""
    body = escape(text)
    if role == "user":
        return f"<s>[INST] {body} [/INST]", 0, 0
    if role == "assistant":
        return f"{body}</s>", 0, len(body)
    return f"<s>[ROLE]{escape(role)}[/ROLE]{body}</s>", 0, 0


def parse(turn: str) -> tuple[str, str]:
    """Role and text of a turn's string."""
    if turn.startswith("<s>[INST] "):
        return "user", unescape(turn[len("<s>[INST] ") : -len(" [/INST]")])
    if turn.startswith("<s>[ROLE]"):
        role, _, body = turn[len("<s>[ROLE]") : -len("</s>")].partition("[/ROLE]")
        return unescape(role), unescape(body)
    return "assistant", unescape(turn[: -len("</s>")])


DIGEST = 16


def turn_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, path (binary), content: a row per turn in the order of turn.

    Rows of one conversation with the same turn are taken by role, then text (null first); repeated rows
    are turns of their own, a null role or text is empty, rows without conv_id are one conversation. Turns
    are read in order within a task, so a conversation of any length passes through as a stream.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]

    def chain(batches):
        known, path, depth = False, b"", 0
        conv = None
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not known or conv_id != conv:
                    known, conv, path, depth = True, conv_id, b"", 0
                content, a, b = render(role, text)
                path += hashlib.sha256(path[-DIGEST:] + content.encode()).digest()[:DIGEST]
                out.append({"conv_id": conv_id, "depth": depth, "path": path, "content": content, "loss_start": a, "loss_stop": b})
                depth += 1
            yield pa.RecordBatch.from_pylist(out, PATHS)

    dealt = rows.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(chain, "conv_id long, depth int, path binary, content string, loss_start int, loss_stop int")


PATHS = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("path", pa.binary()), ("content", pa.string()), ("loss_start", pa.int32()), ("loss_stop", pa.int32())])


def write_tree(conversations: DataFrame, folder: str) -> None:
    """Write `folder`/turns (the tree) and `folder`/ends (the last turn of each conversation) as Parquet.

    turns: node, parent, depth, content, chars, start (of the turn in the depth-first stream of code
    points), position (of its first code point in the conversation), attends (array of stretches [from, to)
    of the stream, neighbours merged), loss_start, loss_stop (of its text under the loss mask, in the content).
    Position ids of a turn are position, position + 1, ... No conversations give no rows.
    """
    paths = materialize(turn_paths(conversations))
    ends = paths.groupBy("conv_id").agg(F.max_by("path", "depth").alias("path"), (F.max("depth") + 1).alias("n_turns"))
    node = lambda c: F.hex(F.substring(c, -DIGEST, DIGEST))
    ends.select("conv_id", node("path").alias("node"), "n_turns", F.hex("path").alias("nodes")).write.parquet(f"{folder}/ends")
    # Turns with the same path are the same; they are merged before they meet.
    merged = paths.groupBy("path").agg(*(F.first(c).alias(c) for c in ("depth", "content", "loss_start", "loss_stop")))
    merged = merged.withColumn("chars", F.char_length("content"))
    stream = materialize(running(merged, [F.col("path")], "chars").drop("index").withColumn("node", node("path")))
    # Each conversation walks down its line once; lines that share a turn say the same of it.
    steps = paths.select("conv_id", "depth", node("path").alias("node")).join(stream.select("node", "start", "chars"), "node")
    dealt = steps.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    attends = dealt.mapInArrow(_walk, "node string, position long, attends array<struct<from: long, to: long>>")
    attends = attends.groupBy("node").agg(F.first("position").alias("position"), F.first("attends").alias("attends"))
    parent = F.when(F.col("depth") > 0, F.hex(F.substring("path", -2 * DIGEST, DIGEST)))
    (
        stream.join(attends, "node")
        .select("node", parent.alias("parent"), "depth", "content", "chars", "start", "position", "attends", "loss_start", "loss_stop")
        .orderBy("start")
        .write.parquet(f"{folder}/turns")
    )


WALKED = pa.schema([("node", pa.string()), ("position", pa.int64()), ("attends", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))])


def _walk(batches):
    """The position of each turn and the stretches of the stream down to it, for rows in the order of conversation and depth."""
    position, spans = 0, []
    for batch in batches:
        out = []
        for depth, name, start, chars in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "start", "chars")), strict=True):
            if depth == 0:
                position, spans = 0, []
            if spans and spans[-1]["to"] == start:
                spans = [*spans[:-1], {"from": spans[-1]["from"], "to": start + chars}]
            else:
                spans = [*spans, {"from": start, "to": start + chars}]
            out.append({"node": name, "position": position, "attends": spans})
            position += chars
        yield pa.RecordBatch.from_pylist(out, WALKED)


def read_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """conv_id, depth, content, position, loss_start, loss_stop of every conversation's turns, from the written tree."""
    ends = spark.read.parquet(f"{folder}/ends")
    turns = spark.read.parquet(f"{folder}/turns")
    width = 2 * DIGEST
    line = ends.select("conv_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("n_turns") - 1), lambda i: F.substring("nodes", i * width + 1, F.lit(width)))).alias("node"))
    return line.join(turns, "node").select("conv_id", "depth", "content", "position", "loss_start", "loss_stop")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
DIGEST_SCHEMA = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(turns: DataFrame) -> DataFrame:
    """What the written turns say of each conversation: columns of DIGESTS, over the texts as they were before escaping."""

    def fold(batches):
        held = None

        def closed(h):
            return {"conv_id": h[0], "n_turns": h[1], "turns_sha256": h[2].hexdigest(), "loss_chars": h[3], "loss_sha256": h[4].hexdigest(), "formatted_chars": h[5]}

        for batch in batches:
            out = []
            for conv_id, content, position, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "content", "position", "loss_start", "loss_stop")), strict=True):
                if held is None or conv_id != held[0]:
                    if held is not None:
                        out.append(closed(held))
                    held = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if position != held[5]:
                    raise ValueError("position ids have a gap")
                role, text = parse(content)
                held[1] += 1
                held[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(content[a:b])
                held[3] += len(loss)
                held[4].update(loss.encode())
                held[5] += len(content)
            yield pa.RecordBatch.from_pylist(out, DIGEST_SCHEMA)
        if held is not None:
            yield pa.RecordBatch.from_pylist([closed(held)], DIGEST_SCHEMA)

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").mapInArrow(fold, DIGESTS)


def op6_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one of control strings, written as a prefix tree and read back."""
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    folder = f"{shared_dir(spark)}/chat-{uuid.uuid4().hex}"
    write_tree(conversations.unionByName(control), folder)
    return digests(read_conversations(spark, folder))
