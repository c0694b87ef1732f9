"""Repair of conversation structure by the cheapest edits, with an audit of them.

The rows of a conversation pass through an automaton of roles: a system row at most at the
start, then user and assistant rows in turn. For each state the dynamic program keeps the least
cost and the audit, a string of edits. Audits are persistent: an edit is a node that links to
the one before it, so states share their prefixes. A node has a rolling hash of its whole audit
and its ancestors at distances of powers of two; two audits of equal cost are compared at the end of
their longest common prefix, which is searched over ancestors with equal hashes and then
verified. Conversations are cut into stretches of rows, each solved for every state it may begin
in, so that a very long one is solved by many tasks; stretches are joined in order.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagcast.llm.common import table
from lagcast.session import materialize

#: Rows in a stretch, as a power of two.
STRETCH_BITS = 12
#: Edits; costs of reroling, deleting, inserting, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLED, DELETED, INSERTED, TRUNCATED = 2, 3, 2, 1
#: What follows each state when a role of this initial comes: 0 nothing yet, 1 system, 2 user, 3 assistant.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ROLES = {2: "user", 3: "assistant"}
#: States in which a conversation may end; faults of rows.
ENDS = (0, 3)
WHOLE, BLANK, REPEATED, CUT_OFF = 0, 1, 2, 3
BASE, PRIME = 911_382_323, (1 << 61) - 1


class Edit:
    """The last edit of an audit, linked to what came before."""

    __slots__ = ("letter", "depth", "code", "above")

    def __init__(self, letter: str = "", before: Edit | None = None):
        self.letter = letter
        if before is None:
            self.depth, self.code, self.above = 0, 0, []
            return
        self.depth, self.code = before.depth + 1, (before.code * BASE + ord(letter)) % PRIME
        # Ancestors at distances 1, 2, 4, ...
        self.above = above = [before]
        k = 0
        while k < len(above[k].above):
            above.append(above[k].above[k])
            k += 1

    def at(self, depth: int) -> Edit:
        node = self
        while (far := node.depth - depth) > 0:
            node = node.above[min(far.bit_length(), len(node.above)) - 1]
        return node

    def audit(self) -> str:
        letters, node = [], self
        while node.depth:
            letters.append(node.letter)
            node = node.above[0]
        return "".join(reversed(letters))


def same(a: Edit, b: Edit) -> bool:
    """Whether two audits of equal length are equal, letter by letter down to what they share."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.above[0], b.above[0]
    return True


def precedes(a: Edit, b: Edit) -> bool:
    """Whether audit a comes before audit b in ASCII order."""
    x, y = a.at(min(a.depth, b.depth)), b.at(min(a.depth, b.depth))
    if x is y or (x.code == y.code and same(x, y)):
        return a.depth < b.depth
    for k in range(len(x.above) - 1, -1, -1):
        if k < len(x.above) and x.above[k].code != y.above[k].code:
            x, y = x.above[k], y.above[k]
    if x.letter != y.letter and same(x.above[0], y.above[0]):
        return x.letter < y.letter
    # Hashes of different audits were equal.
    return a.audit() < b.audit()


def better(found: dict, state: int, cost: int, before: Edit, letter: str) -> None:
    """Takes an edit as the way to a state if it costs less, or as much with an earlier audit."""
    held = found.get(state)
    if held is None or cost < held[0]:
        found[state] = (cost, Edit(letter, before))
    elif cost == held[0] and precedes(made := Edit(letter, before), held[1]):
        found[state] = (cost, made)


def inserted(found: dict) -> dict:
    """States reached by inserting rows, too. Cheaper states come first, so each is final when its turn comes."""
    left = set(found)
    while left:
        state = min(left, key=lambda s: found[s][0])
        left.discard(state)
        cost, node = found[state]
        for follower in {NEXT[state][c] for c in NEXT[state] if c != "s"}:
            held = found.get(follower)
            better(found, follower, cost + INSERTED, node, INSERT)
            if found[follower] is not held:
                left.add(follower)
    return found


def after_row(found: dict, initial: str, fault: int) -> dict:
    """The states after one more row."""
    made: dict = {}
    for state, (cost, node) in found.items():
        better(made, state, cost + DELETED, node, DELETE)
        if fault in (BLANK, REPEATED):
            continue
        stays = cost + (TRUNCATED if fault == CUT_OFF else 0)
        for c, follower in NEXT[state].items():
            if c == initial:
                better(made, follower, stays, node, KEEP)
            elif c != "s":
                better(made, follower, stays + REROLED, node, REROLE)
    return inserted(made)


class Stretch:
    """Consecutive rows of one conversation, solved from each of the given states."""

    def __init__(self, conv_id, stretch: int, states):
        self.conv_id, self.stretch = conv_id, stretch
        self.ways = {s: inserted({s: (0, Edit())}) for s in states}
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.first_role = self.last_role = self.first_turn = self.last_turn = None
        self.rows = 0

    def add(self, turn, initial: str, fault: int) -> None:
        self.ways = {s: after_row(found, initial, fault) for s, found in self.ways.items()}
        self.faults[fault] += 1
        if self.rows and self.last_role + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if not self.rows:
            self.first_role = initial
        self.last_role = initial
        self.rows += 1

    def row(self) -> dict:
        ways = [{"begin": s, "end": t, "cost": cost, "audit": node.audit()} for s, found in self.ways.items() for t, (cost, node) in found.items()]
        return {
            "conv_id": self.conv_id, "stretch": self.stretch, "ways": ways, "blank": self.faults[BLANK], "duplicate": self.faults[REPEATED], "truncated": self.faults[CUT_OFF],
            "illegal": self.illegal, "turns": self.turns, "first_role": self.first_role, "last_role": self.last_role, "first_turn": self.first_turn, "last_turn": self.last_turn,
        }


LONGS = ("blank", "duplicate", "truncated", "illegal", "turns")
STRETCHES = pa.schema(
    [("conv_id", pa.int64()), ("stretch", pa.int64()), ("ways", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])))]
    + [(c, pa.int64()) for c in LONGS]
    + [("first_role", pa.string()), ("last_role", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64())]
)
STRETCHES_DDL = (
    "conv_id long, stretch long, ways array<struct<begin: long, end: long, cost: long, audit: string>>, "
    + ", ".join(f"{c} long" for c in LONGS)
    + ", first_role string, last_role string, first_turn long, last_turn long"
)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that the CRC-32 of their place names; null roles and texts are a blank."""
    place = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(place) % 20).alias("kind")
    ).where("kind <> 0")
    hit = rows.withColumns(
        {
            "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
            "text": F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")),
        }
    )
    return hit.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def ordered(rows: DataFrame) -> DataFrame:
    """The rows by conversation, turn (null first), role and text, stored with `at`, their place in that order.

    `initial` is the role's first letter, ? for one that no edit may keep; `fault` leaves repeats to be found.
    """
    placed = rows.withColumn("salt", F.monotonically_increasing_id())
    kind = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), CUT_OFF).otherwise(WHOLE)
    first = F.substring("role", 1, 1)
    # Equal digests stand for equal conversation, role and text.
    content = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text")
    made = placed.orderBy("conv_id", "turn", "role", "text", "salt").select(
        F.monotonically_increasing_id().alias("at"), "conv_id", "turn", "role", "text", F.when(first.isin("s", "u", "a"), first).otherwise("?").alias("initial"), kind.alias("fault"), F.unhex(F.sha2(content, 256)).alias("content")
    )
    return materialize(made)


def solved_stretches(rows: DataFrame) -> DataFrame:
    """A row per stretch: its counts, and the cheapest audit from each state it may begin in to each it may end in."""
    seen = rows.where(F.col("fault") != BLANK).groupBy("content").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("many")).where("many > 1").select("content", "first")
    narrow = rows.select("at", "conv_id", "turn", "initial", "fault", "content").join(seen, "content", "left")
    fault = F.when((F.col("fault") != BLANK) & (F.col("at") > F.col("first")), REPEATED).otherwise(F.col("fault"))
    dealt = narrow.select("at", F.shiftright("at", STRETCH_BITS).alias("stretch"), "conv_id", "turn", "initial", fault.alias("fault"))

    def solve(batches):
        now = None
        for batch in batches:
            made = []
            for stretch, conv_id, turn, initial, fault in zip(*(batch.column(c).to_pylist() for c in ("stretch", "conv_id", "turn", "initial", "fault")), strict=True):
                if now is None or now.stretch != stretch or now.conv_id != conv_id:
                    # Only the first conversation of a stretch may have begun before it.
                    inside = now is not None and now.stretch == stretch
                    if now is not None:
                        made.append(now.row())
                    now = Stretch(conv_id, stretch, (0,) if inside else range(4))
                now.add(turn, initial, fault)
            yield pa.RecordBatch.from_pylist(made, STRETCHES)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], STRETCHES)

    return materialize(dealt.repartition("stretch").sortWithinPartitions("at").mapInArrow(solve, STRETCHES_DDL))


class Link:
    """The audit of a stretch, linked to that of the stretch before; paths share what they have in common."""

    __slots__ = ("audit", "depth", "before", "begin")

    def __init__(self, audit: str = "", before: Link | None = None, begin: int = 0):
        self.audit, self.before, self.begin, self.depth = audit, before, begin, before.depth + 1 if before else 0


def earlier(a: Link, b: Link) -> bool:
    """Whether one path of stretches spells an earlier audit than another of as many, from where they part."""
    one, two = [], []
    while a is not b:
        one.append(a.audit)
        two.append(b.audit)
        a, b = a.before, b.before
    return "".join(reversed(one)) < "".join(reversed(two))


class Joined:
    """The stretches of one conversation so far."""

    def __init__(self, conv_id):
        self.conv_id, self.stretches, self.paths = conv_id, [], {0: (0, Link())}
        self.sums = dict.fromkeys(LONGS, 0)
        self.last_role = self.first_turn = self.last_turn = None

    def add(self, row: dict) -> None:
        self.stretches.append(row["stretch"])
        made: dict = {}
        for way in row["ways"]:
            if way["begin"] not in self.paths:
                continue
            cost, link = self.paths[way["begin"]]
            cost, link = cost + way["cost"], Link(way["audit"], link, way["begin"])
            held = made.get(way["end"])
            if held is None or cost < held[0] or (cost == held[0] and earlier(link, held[1])):
                made[way["end"]] = (cost, link)
        self.paths = made
        for c in LONGS:
            self.sums[c] += row[c]
        if self.last_role is not None and self.last_role + row["first_role"] not in ("su", "ua", "au"):
            self.sums["illegal"] += 1
        if row["first_turn"] is not None:
            if row["first_turn"] == self.last_turn:
                self.sums["turns"] -= 1
            self.first_turn = row["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = row["last_turn"]
        self.last_role = row["last_role"]

    def rows(self):
        """One row per stretch with its part of the cheapest audit; the last one has the sums."""
        ends = [self.paths[s] for s in ENDS if s in self.paths]
        cost, link = ends[0]
        for other, node in ends[1:]:
            if other < cost or (other == cost and earlier(node, link)):
                cost, link = other, node
        parts = []
        while link.before is not None:
            parts.append((link.audit, link.begin))
            link = link.before
        gaps = self.last_turn - self.first_turn + 1 - self.sums["turns"] if self.first_turn is not None else 0
        for i, ((audit, begin), stretch) in enumerate(zip(reversed(parts), self.stretches, strict=True)):
            last = i == len(parts) - 1
            yield {
                "conv_id": self.conv_id, "stretch": stretch, "part": audit, "begin": begin,
                **{c: self.sums[c] if last else 0 for c in ("blank", "duplicate", "truncated", "illegal")}, "gaps": gaps if last else 0, "cost": cost if last else 0,
            }


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
PARTS = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("part", pa.string()), ("begin", pa.int64())] + [(c, pa.int64()) for c in COUNTS])
PARTS_DDL = "conv_id long, stretch long, part string, begin long, " + ", ".join(f"{c} long" for c in COUNTS)


def audits(stretches: DataFrame) -> DataFrame:
    """Per stretch of a conversation its part of the audit and the state it begins in; the counts stand in the last one's row."""

    def join(batches):
        now = None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if now is None or now.conv_id != row["conv_id"]:
                    made.extend(now.rows() if now is not None else ())
                    now = Joined(row["conv_id"])
                now.add(row)
            yield pa.RecordBatch.from_pylist(made, PARTS)
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(now.rows()), PARTS)

    # The whole audit of a conversation is one value of the result, so its parts may meet in one task.
    return materialize(stretches.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(join, PARTS_DDL))


def repaired_rows(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The repaired conversations, a row per row that stays or comes in: conv_id, stretch, nth (in the stretch), role, text."""
    marks = parts.select("stretch", "conv_id", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), "part", "begin")
    lines = rows.select(F.shiftright("at", STRETCH_BITS).alias("stretch"), "conv_id", "at", "role", "text", F.lit(None).cast("string").alias("part"), F.lit(None).cast("long").alias("begin"))

    def apply(batches):
        part, place, state, nth, now = "", 0, 0, 0, None
        schema = pa.schema([("conv_id", pa.int64()), ("stretch", pa.int64()), ("nth", pa.int64()), ("role", pa.string()), ("text", pa.string())])

        def inserts():
            nonlocal place, state, nth
            while place < len(part) and part[place] == INSERT:
                state = 3 if state == 2 else 2
                yield {"conv_id": now[0], "stretch": now[1], "nth": nth, "role": ROLES[state], "text": ""}
                place, nth = place + 1, nth + 1

        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row["part"] is not None:
                    made.extend(inserts())
                    part, place, state, nth, now = row["part"], 0, row["begin"], 0, (row["conv_id"], row["stretch"])
                    continue
                made.extend(inserts())
                edit = part[place]
                place += 1
                if edit == DELETE:
                    continue
                if edit == KEEP:
                    state, role = NEXT[state][row["role"][0]], row["role"]
                else:
                    state = 3 if state == 2 else 2
                    role = ROLES[state]
                made.append({"conv_id": now[0], "stretch": now[1], "nth": nth, "role": role, "text": row["text"]})
                nth += 1
            yield pa.RecordBatch.from_pylist(made, schema)
        yield pa.RecordBatch.from_pylist(list(inserts()), schema)

    both = marks.unionByName(lines).repartition("stretch").sortWithinPartitions("stretch", "conv_id", "at")
    return both.mapInArrow(apply, "conv_id long, stretch long, nth long, role string, text string")


def text_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` of all its rows, joined by line ends; rows stream through in order."""

    def digest(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
        now, held = None, None
        for batch in batches:
            made = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if held is None or conv_id != now:
                    if held is not None:
                        made.append({"conv_id": now, "repaired_sha256": held.hexdigest()})
                    now, held = conv_id, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_pylist(made, schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": now, "repaired_sha256": held.hexdigest()}], schema)

    # A digest of a whole conversation can only be taken in order, so each goes through one task, row by row.
    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "nth")
    return dealt.mapInArrow(digest, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired rows of conversations (conv_id, turn, role, text; other columns are left out).

    The first is a row per conversation: counts of gaps and faults, cost, audit. The second is as in `repaired_rows`.
    Rows stand by turn (null first), those of one turn by role and text; repeated rows are duplicates. Null
    roles and texts are taken as one blank. Rows without conv_id are one conversation. Roles whose first letter
    is none of s, u, a must be changed or deleted. Long texts are held one by one; a conversation of any
    number of rows is solved in stretches, and no rows give no rows.
    """
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    placed = ordered(known)
    parts = audits(solved_stretches(placed))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "part"))), lambda p: p["part"]), "")
    return parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in COUNTS), whole.alias("audit")), repaired_rows(placed, parts)


def op11_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of all damaged conversations."""
    conversations = table(spark, sf_dir, "conversations")
    found, repaired = repair(damaged(conversations))
    digests = text_digests(repaired).withColumnRenamed("conv_id", "d_conv")
    found = found.withColumnRenamed("conv_id", "f_conv")
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    both = everyone.join(found, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return both.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _cost(way: str, more: str, letter: str) -> str:
    """SQL: a way, nine digits of cost and its audit, with one more edit."""
    return f"lpad(CAST(CAST(substr({way}, 1, 9) AS BIGINT) + {more} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}'"


def _stay(way: str, initial: str) -> str:
    kept, changed = _cost(way, "CAST(r[2] = '3' AS INTEGER)", KEEP), _cost(way, f"{REROLED} + CAST(r[2] = '3' AS INTEGER)", REROLE)
    return f"CASE WHEN r[2] IN ('1', '2') THEN NULL WHEN r[1] = '{initial}' THEN {kept} ELSE {changed} END"


_STEP = f"""[{_cost('w[1]', str(DELETED), DELETE)},
    least({_cost('w[2]', str(DELETED), DELETE)}, CASE WHEN r[1] = 's' AND r[2] NOT IN ('1', '2') THEN {_cost('w[1]', "CAST(r[2] = '3' AS INTEGER)", KEEP)} END),
    least({_cost('w[3]', str(DELETED), DELETE)}, {_stay('w[1]', 'u')}, {_stay('w[2]', 'u')}, {_stay('w[4]', 'u')}),
    least({_cost('w[4]', str(DELETED), DELETE)}, {_stay('w[3]', 'a')})]"""
_WITH_INSERTS = f"""list_transform(list_transform([{_STEP}],
    lambda b: [b[1], b[2], least(b[3], {', '.join(_cost(f'b[{i}]', str(INSERTED), INSERT) for i in (1, 2, 4))}), b[4]]),
    lambda b: [b[1], b[2], b[3], least(b[4], {_cost('b[3]', str(INSERTED), INSERT)})])[1]"""

OP11_SQL = rf"""
WITH poly AS (SELECT list(c ORDER BY i) AS crc_table FROM (
  SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, b: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
place AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
hit AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(range(CAST(length(h) // 2 AS BIGINT)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM place, poly),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS twin FROM hit WHERE kind <> 0)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE '?' END AS initial FROM damaged),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
convs AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 1) AS blank,
    count(*) FILTER (WHERE fault = 2) AS duplicate, count(*) FILTER (WHERE fault = 3) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list_reduce(list_prepend(['000000000', NULL, '000000002I', '000000004II'], list([initial, CAST(fault AS VARCHAR)] ORDER BY i)), lambda w, r: {_WITH_INSERTS}) AS ways
  FROM judged GROUP BY conv_id),
best AS (SELECT *, least(ways[1], ways[4]) AS way FROM convs),
edits AS (
  SELECT conv_id, k, letter, sum(CAST(letter <> 'I' AS INTEGER)) OVER o AS i, sum(CAST(letter <> 'D' AS INTEGER)) OVER o AS p
  FROM (SELECT conv_id, unnest(string_split(substr(way, 10), '')) AS letter, generate_subscripts(string_split(substr(way, 10), ''), 1) AS k FROM best)
  WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
lines AS (
  SELECT e.conv_id, k, letter, p, j.role, CASE WHEN letter = 'I' THEN '' ELSE j.text END AS text,
    max(CAST(p = 1 AND letter = 'K' AND initial = 's' AS INTEGER)) OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN judged j ON j.conv_id IS NOT DISTINCT FROM e.conv_id AND j.i = e.i WHERE letter <> 'D'),
texts AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS digest
  FROM lines GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(CAST(substr(way, 1, 9) AS BIGINT), 0) AS cost, coalesce(substr(way, 10), '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
