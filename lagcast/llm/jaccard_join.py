"""Exact Jaccard join on word shingles that skips by the relations between sets.

A set's shingles stand in one global order (rough frequency class, then hash), and sets with
enough in common share a shingle of their prefixes. Each inverted list names its most
central set, and every set takes as hub the one its lists name most often. A set's
overlap with its hub is computed once. Answers of the sets around a hub then follow from
it: with a bit per hub shingle and the few others apart, overlaps of all of them are bounded
in blocks, and blocks whose distances to the hub lie too far apart, or that are linked through
it already, are skipped. Only sets of different hubs and components that share prefix
shingles are compared one by one. The result is components; no group is expanded into pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import MULTIPLIER, mix, row_slices, table, unused, word_hashes
from lagcast.llm.components import components
from lagcast.session import materialize

WORDS, PERCENT = 5, 75
#: Counters of the frequency sketch, entries of a bucket of lists, sets from which on a list is dealt over several tasks.
SKETCH_BITS, BUCKET_ENTRIES, HOT_ENTRIES = 20, 800_000, 200_000
#: Sets of a hub read beside one copy of the hub; sets in a block; width of a band of distances to the hub.
HEAD_ROWS, BLOCK_ROWS, BAND = 1000, 512, 0.05
#: Lists up to this length are read as one block; longer ones are cut into blocks by size and position of at most BLOCK_ROWS.
LIST_ROWS, HOT = 256, 1 << 40
#: Bands of sizes per doubling, and of positions in a prefix.
SIZE_BANDS, PLACE_BANDS = 6, 8
#: Bits of the filter for documents that are needed again.
FILTER_BITS = 27


def shingle_sets(column, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; with fewer words the whole sequence is one, without words there is none.

    Words are hashed as common.word_hashes does it, runs of them step by step with all bits mixed.
    """
    return [s for _, part in row_slices(column) for s in _shingle_sets(part, words)]


def _shingle_sets(column, words: int) -> list[np.ndarray]:
    hashes, begins = word_hashes(column)
    runs = hashes[: max(0, len(hashes) - words + 1)]
    for j in range(1, words):
        runs = mix(runs * np.uint64(MULTIPLIER) + hashes[j : len(hashes) - words + 1 + j])
    sets = []
    for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
        if b - a >= words:
            sets.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for h in hashes[a:b]:
                whole = mix(whole * np.uint64(MULTIPLIER) + h)
            sets.append(whole)
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def vertex(tokens: np.ndarray) -> int:
    """The number of a set: equal sets have equal ones."""
    return int((mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))).view(np.int64)) if len(tokens) else 0


def probe_length(n, percent: int = PERCENT):
    """Shingles of the prefix with which a set looks for sets that are not larger."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int = PERCENT):
    """Shingles of the prefix under which a set is found by sets that are not smaller."""
    return n - -(-2 * percent * n // (100 + percent)) + 1


def linked(inter, n, m, percent: int = PERCENT):
    return 100 * inter >= percent * (n + m - inter)


def sketch(docs: DataFrame) -> np.ndarray:
    """How often shingles fall on each counter, over all documents."""
    size, part = 1 << SKETCH_BITS, min(1 << 12, 1 << SKETCH_BITS)

    def count(batches):
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for tokens in shingle_sets(batch.column("text")):
                total[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] += 1
        for i in range(0, size, part):
            own = total[i : i + part]
            there = np.flatnonzero(own)
            if len(there):
                # Counters of a task are small numbers; few of them are sent with their places.
                kind = np.min_scalar_type(int(own.max()))
                few = 2 * len(there) < part
                packed = [i, there.astype(np.uint16).tobytes() if few else b"", (own[there] if few else own).astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in packed], ["at", "places", "counts"])

    def add(batches):
        at, total = None, np.zeros(part, np.int64)
        for batch in batches:
            for i, places, counts in zip(*(batch.column(c).to_pylist() for c in ("at", "places", "counts")), strict=True):
                if i != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], ["at", "counts"])
                    at, total = i, np.zeros(part, np.int64)
                at_places = np.frombuffer(places, np.uint16) if places else np.arange(part)
                total[at_places] += np.frombuffer(counts, f"u{len(counts) // len(at_places)}")
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], ["at", "counts"])

    parts = docs.select("text").mapInArrow(count, "at long, places binary, counts binary").repartition("at").sortWithinPartitions("at")
    counts = np.zeros(size, np.int64)
    # As many numbers as the sketch has counters, whatever the size of the corpus.
    for r in parts.mapInArrow(add, "at long, counts binary").collect():
        counts[r["at"] : r["at"] + part] = np.frombuffer(r["counts"], np.int64)
    return counts


def frequency_classes(counts: np.ndarray) -> np.ndarray:
    """0 where a count is what rare shingles make by chance, else the logarithm of its excess."""
    mean = max(1.0, counts.mean())
    return np.floor(1 + np.log2(np.maximum((counts - mean) / (4 * np.sqrt(mean)), 0.5))).astype(np.uint8)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text, row_key: a hash of both, so repeated rows have one key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_key", F.xxhash64("doc_id", "text"))


def set_members(sets: DataFrame) -> DataFrame:
    """v, row_key of one of its documents, doc_id (the smallest, null only if all are)."""
    return sets.where("n > 0").groupBy("v").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("doc_id"))


def with_components(sets: DataFrame, members: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, row_key, component, n_shingles, component_id of every document, from the components found (vertex, root)."""
    named = members.join(found.select(F.col("vertex").alias("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = named.join(lowest, "root").select("v", "component_id", "root")
    return sets.join(by_set, "v", "left").select(
        "doc_id", "row_key", F.when(F.col("n") > 0, F.col("root")).alias("component"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (hash of doc_id and text), v (number of the set), n (its size; 0 without words), a row per document."""

    def make(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text"))
            made = [pa.array([vertex(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), *made], ["doc_id", "row_key", "v", "n"])

    return materialize(docs.mapInArrow(make, "doc_id long, row_key long, v long, n long"))


LISTS = pa.schema([("token", pa.int64()), ("v", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("hub", pa.int64()), ("many", pa.int64())])


def inverted_lists(docs: DataFrame, seen_counts: np.ndarray, entries: int, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """token, v, n, pos (a lower bound of the place in the set), hub, many: prefix entries that share a token with another set.

    Entries travel in packed arrays, one row per bucket of tokens and task. Lists of very frequent tokens
    are dealt over buckets by set. `hub` is the most central set of the entry's list (or its part), `many` the
    length of the list, HOT for one that is dealt.
    """
    buckets = max(1, -(-entries // BUCKET_ENTRIES))
    # Parts of a list, as a power of two.
    parts_of = np.floor(np.log2(np.maximum(seen_counts / hot_entries, 0.5)) + 1).astype(np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast((frequency_classes(seen_counts), parts_of))

    def pack(batches):
        def flush():
            tokens, places, rows, hot = (np.concatenate(x) for x in (held["tokens"], held["pos"], held["rows"], held["hot"]))
            v, n = np.array(held["v"], np.int64), np.array(held["n"], np.int64)
            salt = np.where(hot > 0, mix(v.view(np.uint64))[rows] % (np.uint64(1) << hot.astype(np.uint64)), np.uint64(0))
            bucket = (mix(tokens + salt) % np.uint64(buckets)).astype(np.int64) + np.where(hot > 0, buckets, 0)
            order = np.argsort(bucket, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                own, at = np.unique(rows[part], return_index=True)
                counts = np.diff(np.append(at, len(part))).astype(np.uint32)
                packed = [int(bucket[part[0]]), *(x.tobytes() for x in (v[own], n[own].astype(np.uint32), counts, tokens[part], places[part]))]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in packed], ["bucket", "v", "n", "counts", "tokens", "pos"])

        fresh = lambda: {k: [] for k in ("v", "n", "tokens", "pos", "rows", "hot")} | {"size": 0}
        held = fresh()
        for batch in batches:
            seen = set()
            for tokens in (s for _, part in row_slices(batch.column("text")) for s in _shingle_sets(part, WORDS)):
                v, n = vertex(tokens), len(tokens)
                if not n or v in seen:
                    continue
                seen.add(v)
                at = (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                level = shared.value[0][at]
                if level.any():
                    order = np.argsort(level, kind="stable")
                    tokens, at = tokens[order], at[order]
                k = int(probe_length(n))
                held["tokens"].append(tokens[:k])
                # Eighth bits of the place suffice; rounding down keeps all bounds safe.
                held["pos"].append((np.arange(k) * 256 // k).astype(np.uint8))
                held["rows"].append(np.full(k, len(held["v"]), np.int32))
                held["hot"].append(shared.value[1][at[:k]])
                held["v"].append(v)
                held["n"].append(n)
                held["size"] += k
                if held["size"] >= 300_000:
                    yield from flush()
                    held = fresh()
        if held["v"]:
            yield from flush()

    def lists(parts: list[dict], hot: bool):
        v = np.concatenate([np.repeat(np.frombuffer(p["v"], np.int64), np.frombuffer(p["counts"], np.uint32)) for p in parts])
        n = np.concatenate([np.repeat(np.frombuffer(p["n"], np.uint32), np.frombuffer(p["counts"], np.uint32)) for p in parts]).astype(np.int64)
        tokens = np.concatenate([np.frombuffer(p["tokens"], np.uint64) for p in parts])
        pos = np.concatenate([np.frombuffer(p["pos"], np.uint8) for p in parts]).astype(np.int64)
        order = np.lexsort((v, tokens))
        v, n, tokens, pos = v[order], n[order], tokens[order], pos[order]
        # Copies of one set.
        keep = np.append(True, (tokens[1:] != tokens[:-1]) | (v[1:] != v[:-1])) if len(v) else np.zeros(0, bool)
        all_v = v[keep]
        v, n, tokens, pos = all_v, n[keep], tokens[keep], pos[keep]
        first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        size = np.diff(np.append(first, len(tokens)))
        run = np.repeat(np.arange(len(first)), size)
        several = size[run] > 1
        # Central is the set most of whose tokens here are in other sets, too.
        names, at = np.unique(v, return_inverse=True)
        share = np.bincount(at, several) / np.bincount(at)
        best = np.lexsort((v, n, share[at], run))
        hub = v[best[np.append(first[1:], len(tokens)) - 1]][run]
        stay = several | hot
        yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (tokens.view(np.int64), v, n, pos * probe_length(n) // 256, hub, np.full(len(v), HOT) if hot else size[run])], LISTS.names)

    def unpack(batches):
        at, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != at and parts:
                    yield from lists(parts, at >= buckets)
                    parts = []
                at = row["bucket"]
                parts.append(row)
        if parts:
            yield from lists(parts, at >= buckets)

    packed = docs.mapInArrow(pack, "bucket long, v binary, n binary, counts binary, tokens binary, pos binary")
    dealt = packed.repartition(2 * buckets, "bucket").sortWithinPartitions("bucket")
    return materialize(dealt.mapInArrow(unpack, "token long, v long, n long, pos long, hub long, many long"))


def hubs(lists: DataFrame) -> DataFrame:
    """v, hub: for each set the set that its lists name most often; hubs of parts of one list are joined under one of them.

    A set whose hub is in less than a quarter of its prefix is better off without one.
    """

    def named(times: DataFrame) -> DataFrame:
        near = times.where(4 * F.col("times") >= probe_length_column(PERCENT))
        return near.groupBy("v").agg(F.max_by("hub", F.struct("times", "hub")).alias("hub"))

    count = F.count(F.lit(1))
    first = materialize(lists.where("v <> hub").groupBy("v", "n", "hub").agg(count.alias("times")))
    # The same once more among the hubs alone, over whole lists; central is whose prefix is found in other sets most.
    among = materialize(lists.join(first.select(F.col("hub").alias("v")).distinct(), "v", "left_semi").select("token", "v", "n"))
    shares = among.groupBy("v").agg((count / F.max(probe_length_column(PERCENT))).alias("share"))
    among = among.join(shares, "v")
    central = among.groupBy("token").agg(F.max(F.struct("share", "n", "v")).alias("best"), count.alias("many")).where("many > 1")
    above = among.join(central, "token").select("v", "n", F.col("best.v").alias("hub")).where("v <> hub")
    second = named(above.groupBy("v", "n", "hub").agg(count.alias("times"))).select(F.col("v").alias("hub"), F.col("hub").alias("upper"))
    moved = first.join(second, "hub", "left").withColumn("hub", F.coalesce("upper", "hub")).where("v <> hub")
    return materialize(named(moved.groupBy("v", "n", "hub").agg(F.sum("times").alias("times"))))


def only_needed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents that may be in `wanted` (row_key): a filter sized by their number, so that few others are moved.

    Beyond the filter's largest size every document is moved, which changes the cost only.
    """
    many = wanted.select("row_key").distinct().count()
    # A few bits in a thousand are set, so as few documents pass by chance.
    bits = max(16, min(FILTER_BITS, int(many).bit_length() + 8))
    if many > 1 << FILTER_BITS:
        return docs
    # Bitmaps of Spark count places from 1; a bitmap has 2**15 bits.
    place = F.shiftrightunsigned("row_key", 64 - bits) + 1
    maps = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    size = 4096
    filled = bytearray((1 << bits) // 8)
    # At most 4096 rows, whatever the number of documents.
    for r in maps.collect():
        filled[(r["part"] - 1) * size : r["part"] * size] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bytes(filled))

    @F.arrow_udf("boolean")
    def may_be(places: pa.Array) -> pa.Array:
        at = places.to_numpy(zero_copy_only=False) - 1
        held = np.frombuffer(shared.value, np.uint8)
        return pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return docs.where(may_be(place))


MEASURED = "head long, v long, head_n long, n long, shared long, bits binary, others binary"


def measure(docs: DataFrame, members: DataFrame, pairs: DataFrame, relations: bool, words: int = WORDS) -> DataFrame:
    """Overlap of each pair (head, v) of sets, from whole texts (row_key, text); columns of MEASURED.

    `members` (row_key, v) names a document for each set. A head is read once before up to HEAD_ROWS of its
    sets, so a head with many is dealt over tasks. With `relations`, `bits` has a bit per shingle of the
    head, and `others` the shingles outside it.
    """
    counts = pairs.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / HEAD_ROWS).alias("parts"))
    salted = pairs.join(counts, "head").select("head", "v", F.pmod(F.xxhash64("v"), F.col("parts")).alias("salt"), F.lit(1).alias("role"))
    heads = counts.select("head", F.col("head").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = materialize(salted.unionByName(heads).join(members, "v").select("row_key", "head", "v", "salt", "role"))
    # Repeated rows have one key and one text.
    once = only_needed(docs.select("row_key", "text"), wanted).dropDuplicates(["row_key"])
    texts = wanted.join(once, "row_key").select("head", "v", "salt", "role", "text")

    def compare(batches):
        name, head = None, None
        for batch in batches:
            for first, part in row_slices(batch.column("text")):
                out = []
                rows = zip(*(batch.column(c).slice(first, len(part)).to_pylist() for c in ("head", "v", "salt", "role")), _shingle_sets(part, words), strict=True)
                for head_v, v, salt, role, tokens in rows:
                    # Texts whose row keys collide.
                    if vertex(tokens) != v:
                        continue
                    if role == 0:
                        name, head = (head_v, salt), tokens
                        continue
                    if name != (head_v, salt):
                        raise ValueError("a head is missing")
                    at = np.minimum(np.searchsorted(head, tokens), len(head) - 1)
                    inside = head[at] == tokens
                    found = {"head": head_v, "v": v, "head_n": len(head), "n": len(tokens), "shared": int(inside.sum()), "bits": None, "others": None}
                    if relations:
                        mask = np.zeros(len(head), bool)
                        mask[at[inside]] = True
                        found |= {"bits": np.packbits(mask).tobytes(), "others": tokens[~inside].tobytes()}
                    out.append(found)
                yield pa.RecordBatch.from_pylist(out, OVERLAPS)

    dealt = texts.repartition("head", "salt").sortWithinPartitions("head", "salt", "role")
    return materialize(dealt.mapInArrow(compare, MEASURED))


OVERLAPS = pa.schema([(c, pa.int64()) for c in ("head", "v", "head_n", "n", "shared")] + [("bits", pa.binary()), ("others", pa.binary())])


def links_around_hubs(measured: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b: enough links between sets of one hub to join what is linked, apart from those linked to the hub itself.

    Sets stand in bands of distance to the hub, bands in blocks of about BLOCK_ROWS. Two sets farther apart in
    distance to the hub than the threshold allows are not linked (Jaccard distance is a metric), and two
    linked to the hub are joined through it, so only blocks with an unlinked set within reach are compared.
    """
    distance = 1 - F.col("shared") / (F.col("head_n") + F.col("n") - F.col("shared"))
    joined = 100 * F.col("shared") >= percent * (F.col("head_n") + F.col("n") - F.col("shared"))
    inner, reach = int(round((100 - percent) / 100 / BAND)), int(round((100 - percent) / 100 / BAND)) + 1
    band = F.floor(distance / BAND)
    rows = measured.withColumn("band", F.when(joined, F.least(band, F.lit(inner - 1))).otherwise(F.greatest(band, F.lit(inner))))
    counts = materialize(rows.groupBy("head", "band").agg(F.count(F.lit(1)).alias("many")).withColumn("parts", F.ceil(F.col("many") / BLOCK_ROWS)))
    blocks = materialize(counts.select("head", "band", "many", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "parts"))
    one, two = blocks.alias("x"), blocks.alias("y")
    ordered = F.expr("x.head = y.head AND (x.band < y.band OR x.band = y.band AND x.part <= y.part)")
    near = (F.col("y.band") >= inner) & (F.col("y.band") - F.col("x.band") <= reach)
    # A set alone in its block has nothing to meet there.
    alone = F.expr("x.band = y.band AND x.many = 1")
    meetings = one.join(two, ordered & near & ~alone).select(
        "x.head", F.col("x.band").alias("band1"), F.col("x.part").alias("part1"), F.col("y.band").alias("band2"), F.col("y.part").alias("part2")
    )
    meetings = materialize(meetings.withColumn("meeting", F.xxhash64("head", "band1", "part1", "band2", "part2")))
    sides = meetings.select("head", "meeting", F.col("band1").alias("band"), F.col("part1").alias("part"), F.lit(0).alias("side")).unionByName(
        meetings.where("band1 <> band2 OR part1 <> part2").select("head", "meeting", F.col("band2").alias("band"), F.col("part2").alias("part"), F.lit(1).alias("side"))
    )
    placed = rows.join(counts.drop("many"), ["head", "band"]).withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")))
    dealt = placed.join(sides, ["head", "band", "part"]).select("head", "band", "meeting", "side", "v", "head_n", "n", "shared", "bits", "others")

    def meet(group):
        rows = group.to_pylist()
        v = [r["v"] for r in rows]
        n, shared = np.array([r["n"] for r in rows]), np.array([r["shared"] for r in rows])
        side, band = np.array([r["side"] for r in rows]), np.array([r["band"] for r in rows])
        width = rows[0]["head_n"]
        bits = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=width) for r in rows]).astype(np.float32)
        others = [np.frombuffer(r["others"], np.uint64) for r in rows]
        root = list(range(len(rows)))

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if (side == 1).any() else (np.arange(len(rows)),) * 2
        inside = (bits[left] @ bits[right].T).astype(np.int64)
        both = n[left][:, None] + n[right][None]
        most = inside + np.minimum((n - shared)[left][:, None], (n - shared)[right][None])
        able = (100 + percent) * most >= percent * both
        # Two sets that are linked to the hub need no link of their own.
        able &= (band[left][:, None] >= inner) | (band[right][None] >= inner)
        if left is right:
            able = np.triu(able, 1)
        made = []
        for i, j in zip(*np.nonzero(able), strict=True):
            a, b = int(left[i]), int(right[j])
            if top(a) == top(b) or v[a] == v[b]:
                continue
            total = int(inside[i, j]) + len(np.intersect1d(others[a], others[b], assume_unique=True))
            if linked(total, n[a], n[b], percent):
                root[top(a)] = top(b)
                made.append((v[a], v[b]))
        return pa.table({"a": pa.array([x for x, _ in made], pa.int64()), "b": pa.array([x for _, x in made], pa.int64())})

    return dealt.groupBy("meeting").applyInArrow(meet, "a long, b long")


ENTRY = "token long, v long, n long, pos long, hub long, root long"
MET = "v1 long, v2 long, n1 long, n2 long, pos1 long, pos2 long"


def may_link(a: dict, b: dict, percent: int) -> np.ndarray:
    """Whether entries of one token may be of linked sets that are not known to be: by sizes and by places in their prefixes."""
    n, m = a["n"], b["n"]
    small_n = np.minimum(n, m)
    small_pos = np.where((n < m) | ((n == m) & (a["v"] < b["v"])), a["pos"], b["pos"])
    # Sets around one hub, and a set with its own hub, are compared already.
    able = (a["root"] != b["root"]) & (a["hub"] != b["hub"]) & (a["hub"] != b["v"]) & (b["hub"] != a["v"])
    able &= 100 * small_n >= percent * np.maximum(n, m)
    able &= small_pos <= small_n - -(-2 * percent * small_n // (100 + percent))
    # A pair's first shared shingle leaves room for enough further ones in both sets.
    return able & ((100 + percent) * np.minimum(n - a["pos"], m - b["pos"]) >= percent * (n + m))


def met_batch(a: dict, b: dict) -> pa.RecordBatch:
    """Rows of MET; the set of the lower root comes first."""
    low = a["root"] < b["root"]
    columns = [np.where(low, one[c], other[c]) for c in ("v", "n", "pos") for one, other in ((a, b), (b, a))]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], [c.split()[0] for c in MET.split(", ")])


def short_lists(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of MET from lists that are one block: each entry is compared with those after it in its list."""
    names = [c.split()[0] for c in ENTRY.split(", ")]

    def pairs(held):
        token = held["token"]
        last = np.searchsorted(token, token, "right")
        left, step = np.arange(len(token)), 1
        while len(left := left[left + step < last[left]]):
            one, other = ({c: x[at] for c, x in held.items()} for at in (left, left + step))
            able = may_link(one, other, percent)
            if able.any():
                yield met_batch(*({c: x[able] for c, x in side.items()} for side in (one, other)))
            step += 1

    def meet(batches):
        rest = None
        for batch in batches:
            held = {c: batch.column(c).to_numpy() for c in names}
            if rest is not None:
                held = {c: np.concatenate((rest[c], held[c])) for c in names}
            # The last list may go on in the next batch.
            whole = int(np.searchsorted(held["token"], held["token"][-1])) if len(held["token"]) else 0
            rest = {c: x[whole:] for c, x in held.items()}
            yield from pairs({c: x[:whole] for c, x in held.items()})
        if rest is not None:
            yield from pairs(rest)

    return entries.select(*names).repartition("token").sortWithinPartitions("token").mapInArrow(meet, MET)


def long_lists(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of MET from long lists in blocks by size and place; blocks whose bounds exclude a link are skipped, heads first."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    size_band = F.floor(F.log2("n") * SIZE_BANDS)
    place_band = F.floor(F.col("pos") * PLACE_BANDS / probe_length_column(percent))
    banded = materialize(entries.select(*names, size_band.alias("size_band"), place_band.alias("place_band")))
    band = ["token", "size_band", "place_band"]
    counts = banded.groupBy(*band).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("parts"))
    placed = materialize(banded.join(counts, band).withColumn("block", F.xxhash64("size_band", "place_band", F.pmod(F.xxhash64("v"), F.col("parts")))).select(*names, "block"))
    bounds = [f(c).alias(f"{c}_{name}") for c in ("n", "root", "hub") for name, f in (("low", F.min), ("high", F.max))]
    heads = materialize(placed.groupBy("token", "block").agg(*bounds, F.max(F.col("n") - F.col("pos")).alias("room")))
    near = f"100 * x.n_high >= {percent} * y.n_low AND 100 * y.n_high >= {percent} * x.n_low"
    rooms = f"{100 + percent} * least(x.room, y.room) >= {percent} * (x.n_low + y.n_low)"
    apart = "NOT (x.root_low = x.root_high AND y.root_low = y.root_high AND x.root_low = y.root_low) AND NOT (x.hub_low = x.hub_high AND y.hub_low = y.hub_high AND x.hub_low = y.hub_low)"
    met = heads.alias("x").join(heads.alias("y"), F.expr(f"x.token = y.token AND x.block <= y.block AND {near} AND {rooms} AND {apart}"))
    meetings = materialize(met.select("x.token", F.col("x.block").alias("one"), F.col("y.block").alias("two"), F.xxhash64("x.token", "x.block", "y.block").alias("meeting")))
    sides = meetings.select("token", F.col("one").alias("block"), "meeting", F.lit(0).alias("side")).unionByName(
        meetings.where("one <> two").select("token", F.col("two").alias("block"), "meeting", F.lit(1).alias("side"))
    )
    dealt = placed.join(sides, ["token", "block"]).select("meeting", "side", *names)

    def meet(group):
        held = {c: group.column(c).to_numpy() for c in [*names, "side"]}
        one, other = (np.flatnonzero(held["side"] == i) for i in (0, 1))
        alone = not len(other)
        found = []
        for i in one:
            at = one[one > i] if alone else other
            mine = {c: np.full(len(at), x[i]) for c, x in held.items()}
            theirs = {c: x[at] for c, x in held.items()}
            able = may_link(mine, theirs, percent)
            if able.any():
                found.append(met_batch(*({c: x[able] for c, x in side.items()} for side in (mine, theirs))))
        return pa.Table.from_batches(found, pa.schema([(c.split()[0], pa.int64()) for c in MET.split(", ")]))

    return dealt.groupBy("meeting").applyInArrow(meet, MET)


def cross_pairs(lists: DataFrame, hub_of: DataFrame, roots: DataFrame, percent: int = PERCENT) -> DataFrame:
    """head, v: sets of different hubs and components that share prefix shingles and may reach the threshold."""
    known = lists.select("token", "v", "n", "pos", "many").join(hub_of, "v", "left").join(roots.select(F.col("vertex").alias("v"), "root"), "v", "left")
    # A hub stands with the sets around it.
    known = known.withColumn("root", F.coalesce("root", "v")).withColumn("hub", F.coalesce("hub", "v"))
    total, needed = 100 + percent, percent
    both = needed * (F.col("n1") + F.col("n2"))
    short = F.col("many") <= LIST_ROWS
    met = short_lists(known.where(short), percent).unionByName(long_lists(known.where(~short), percent))
    # Rows are left out only behind these places, so sharing so many up to them, two sets have at most this much in common.
    counted = met.groupBy("v1", "v2", "n1", "n2").agg(F.count(F.lit(1)).alias("times"), F.max("pos1").alias("last1"), F.max("pos2").alias("last2"))
    most = F.col("times") + F.least(F.col("n1") - F.col("last1") - 1, F.col("n2") - F.col("last2") - 1)
    able = materialize(counted.where(total * most >= both).select("v1", "v2", "n1", "n2"))
    # Past the end of the prefix that ends first, no more than the rest of that set can be shared.
    prefixes = lists.join(able.select(F.explode(F.array("v1", "v2")).alias("v")).distinct(), "v", "left_semi").groupBy("v").agg(F.collect_list("token").alias("tokens"))
    one, two = (prefixes.select(F.col("v").alias(f"v{k}"), F.col("tokens").alias(f"tokens{k}")) for k in (1, 2))
    rest = F.greatest(*(F.col(c) - probe_length_column(percent, c) for c in ("n1", "n2")))
    shared = F.size(F.array_intersect("tokens1", "tokens2"))
    kept = able.join(one, "v1").join(two, "v2").where(total * (shared + rest) >= both)
    return materialize(kept.select(F.col("v1").alias("head"), F.col("v2").alias("v")))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, hot_entries: int = HOT_ENTRIES) -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, component (number of the component; null without words) of every document.

    Two documents link when 100 * intersection >= percent * union of their sets of 5-word shingles (A-Z lower-cased;
    with fewer words the whole sequence). component_id is the smallest doc_id that links lead to. Texts
    without words, and nulls, link to nothing, not to each other either. Repeated rows and equal sets
    are one component; a null doc_id takes part, but does not name a component unless all its doc_ids
    are null. Extra columns are left out; no rows give no rows.
    """
    rows = keyed_texts(docs)
    sets = set_table(rows)
    entries = sets.agg(F.coalesce(F.sum(probe_length_column(percent)), F.lit(0))).first()[0]
    members = materialize(set_members(sets))
    lists = inverted_lists(rows, sketch(rows), int(entries), hot_entries)
    hub_of = hubs(lists)
    measured = measure(rows, members.select("row_key", "v"), hub_of.select(F.col("hub").alias("head"), "v"), relations=True)
    hit = 100 * F.col("shared") >= percent * (F.col("head_n") + F.col("n") - F.col("shared"))
    inner = materialize(measured.where(hit).select(F.col("head").alias("a"), F.col("v").alias("b")).unionByName(links_around_hubs(measured, percent)))
    roots = components(inner)
    outer = measure(rows, members.select("row_key", "v"), cross_pairs(lists, hub_of, roots, percent), relations=False)
    everything = components(inner.unionByName(outer.where(hit).select(F.col("head").alias("a"), F.col("v").alias("b"))))
    return with_components(sets, members, everything)


def probe_length_column(percent: int, n: str = "n"):
    return F.col(n) - F.ceil(F.col(n) * percent / 100) + 1


def op8_skipping_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of `docs`, one per component: the one with the smallest doc_id (null last); all rows without words stay."""
    found = near_duplicates(docs).where("n_shingles > 0")
    key, check = unused(docs, "row_key"), unused(docs, "row_check")
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")).select(F.col("first.row_key").alias(key))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), "text"))
    # Repeated rows have one key; the second hash keeps apart what the first may not.
    stay = keyed.where(worded).join(first, key, "left_semi").withColumn(check, F.crc32("text")).dropDuplicates([key, check, "doc_id"])
    return stay.select(*docs.columns).unionByName(docs.where(~worded))
