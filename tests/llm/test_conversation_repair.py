"""Repair of conversations: edits against all edits, counts and texts against a plain walk, SQL against both."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lagcast.llm import conversation_repair as repair

COLUMNS = "conv_id long, turn long, role string, text string, at string, stretch int"
LEGAL = re.compile("(s?(ua)+)?")


def every_audit(rows):
    """Least (cost, audit) over all edits of few rows, up to four inserts in a row."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in (1, 2) for e, (_, f) in zip(edits, rows, strict=True)):
            continue
        base = sum({"D": 3, "K": 0, "R": 2}[e] + (e != "D" and f == 3) for e, (_, f) in zip(edits, rows, strict=True))
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            cost = base + 2 * sum(gaps)
            audit = "".join("I" * g + e for g, e in itertools.zip_longest(gaps, edits, fillvalue=""))
            if best is not None and (cost, audit) >= best:
                continue
            # Free letters may be either role.
            kept = [i if e == "K" else "." for e, (i, _) in zip(edits, rows, strict=True) if e != "D"]
            places, at = [], 0
            for letter in audit:
                if letter == "K":
                    while edits[at] == "D":
                        at += 1
                    places.append(rows[at][0])
                    at += 1
                elif letter == "R":
                    while edits[at] == "D":
                        at += 1
                    places.append("ua")
                    at += 1
                elif letter == "I":
                    places.append("ua")
            assert len([p for p in places if p != "ua"]) == len([k for k in kept if k != "."])
            if any(LEGAL.fullmatch("".join(c)) for c in itertools.product(*places)):
                best = (cost, audit)
    return best


def walked(rows):
    """(cost, audit) by strings alone, for longer conversations."""
    ways = {0: (0, "")}

    def take(found, state, way):
        found[state] = min(found.get(state, way), way)

    def inserts(found):
        for _ in range(3):
            for state, (cost, audit) in list(found.items()):
                take(found, 3 if state == 2 else 2, (cost + 2, audit + "I"))
        return found

    ways = inserts(ways)
    for initial, fault in rows:
        made = {}
        for state, (cost, audit) in ways.items():
            take(made, state, (cost + 3, audit + "D"))
            if fault in (1, 2):
                continue
            cost += fault == 3
            if state == 0 and initial == "s":
                take(made, 1, (cost, audit + "K"))
            wanted, follower = ("a", 3) if state == 2 else ("u", 2)
            take(made, follower, (cost, audit + "K") if wanted == initial else (cost + 2, audit + "R"))
        ways = inserts(made)
    return min(w for s, w in ways.items() if s in (0, 3))


def solved(rows, cut):
    """The same by stretches of `cut` rows."""
    joined = repair.Joined(7)
    for at in range(0, len(rows), cut):
        part = repair.Stretch(7, at, range(4))
        for initial, fault in rows[at : at + cut]:
            part.add(at, initial, fault)
        joined.add(part.row())
    made = list(joined.rows())
    return made[-1]["cost"], "".join(r["part"] for r in made)


def random_rows(rng, n):
    return [(rng.choice("suaua?"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]


def test_walk_equals_all_edits():
    rng = random.Random(2)
    for n in (1, 1, 2, 2, 3, 3, 3, 3):
        rows = random_rows(rng, n)
        assert every_audit(rows) == walked(rows) == solved(rows, 2), rows


@pytest.mark.parametrize("prime", [repair.PRIME, 7])
def test_stretches_equal_the_walk(prime, monkeypatch):
    """Also where most hashes collide."""
    monkeypatch.setattr(repair, "PRIME", prime)
    rng = random.Random(3)
    for _ in range(150):
        rows = random_rows(rng, rng.randrange(1, 30))
        assert walked(rows) == solved(rows, rng.choice([1, 3, 50])), rows


def test_order_of_audits(monkeypatch):
    rng = random.Random(4)
    for prime in (repair.PRIME, 5):
        monkeypatch.setattr(repair, "PRIME", prime)
        for _ in range(300):
            start = repair.Edit()
            for c in "".join(rng.choices("KD", k=rng.randrange(20))):
                start = repair.Edit(c, start)
            ends = []
            for _ in range(2):
                node = start
                for c in rng.choices("DIKR", k=rng.randrange(12)):
                    node = repair.Edit(c, node)
                ends.append(node)
            assert repair.precedes(*ends) == (ends[0].audit() < ends[1].audit())


TEXTS = ["Hello there.", "what", "fine!", "", "  \t", "No? ", "same.", "same.", "é漢.", None, "a\nb. \n", "x" * 3000 + "?"]


def conversation_rows():
    rng, rows = random.Random(6), []
    for conv in [*range(60), None, -5]:
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "Human", ""])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, rng.choice(TEXTS)))
    rows += rows[:5] + [(900, t, ("user", "assistant")[t % 2], f"row {t % 7} of it.") for t in range(300)]
    return rows


def plain(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        held = groups[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    found = []
    for conv, held in groups.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, steps = set(), []
        for _, role, text in held:
            words = re.findall("[^\x20\x09-\x0d]", text)
            steps.append((role[:1] if role[:1] in ("s", "u", "a") else "?", 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0))
            seen.add((role, text))
        cost, audit = walked(steps)
        turns = [t for t, _, _ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(steps))
        out, left = [], iter(held)
        for letter in audit:
            row = next(left) if letter != "I" else (None, None, "")
            if letter != "D":
                before = out[-1][0][0] if out else ""
                out.append((row[1] if letter == "K" else "assistant" if before == "u" else "user", row[2]))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
        faults = [f for _, f in steps]
        found.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest))
    return sorted(found, key=repr)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("bits", [12, 3])
def test_query_equals_the_walk(llm, tmp_path, bits, monkeypatch):
    monkeypatch.setattr(repair, "STRETCH_BITS", bits)
    rows = conversation_rows()
    llm.createDataFrame([(*r, "x", 1) for r in rows], COLUMNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    made = repair.op11_conversation_audit(llm, str(tmp_path))
    assert sorted((tuple(r[c] for c in NAMES) for r in made.collect()), key=repr) == plain(rows)


def test_sql_equals_the_walk():
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", conversation_rows())
    made = db.execute(f"SELECT {', '.join(NAMES)} FROM ({repair.OP11_SQL})").fetchall()
    assert sorted(made, key=repr) == plain(conversation_rows())


def test_repaired_rows_and_no_rows(llm):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Yes."), (2, 0, "system", "Be kind."), (2, 1, "assistant", "ok.")]
    counts, repaired = repair.repair(llm.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.conv_id: (r.cost, r.audit) for r in counts.collect()} == {1: (3, "KDK"), 2: (2, "KIK")}
    assert [(r.role, r.text) for r in repaired.orderBy("conv_id", "stretch", "nth").collect()] == [("user", "Hi."), ("assistant", "Yes."), ("system", "Be kind."), ("user", ""), ("assistant", "ok.")]
    counts, repaired = repair.repair(llm.createDataFrame([], COLUMNS))
    assert counts.count() == 0 and repaired.count() == 0
