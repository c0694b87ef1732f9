"""Operators on documents against plain versions, on rows of every awkward kind."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import WORD, document_rows, plain_components
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lagcast.llm import jaccard_join, mixing, orc_output, packing, piecewise, sharding

ROWS = [(r[0], r[1]) for r in document_rows()]


def plain_ids(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_follow_their_definition(documents):
    got = {(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in piecewise.fingerprints(documents).collect()}
    texts = defaultdict(list)
    for doc_id, text in ROWS:
        texts[doc_id].append(text or "")
    # Ids that are there once, between ids that are there once, have one edited text.
    ids = sorted((d for d in texts if d is not None), reverse=True)
    single = 0
    for doc_id, following in zip(ids[:-1], ids[1:], strict=True):
        if len(texts[doc_id]) == len(texts[following]) == 1:
            text, cut = texts[doc_id][0], len(texts[doc_id][0]) // 3
            edited = text[: len(text) - cut] + texts[following][0][:cut]
            assert (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()) in got
            single += 1
    assert single > 30 and sum(1 for _ in piecewise.fingerprints(documents).collect()) == len(ROWS)


def test_likeness_of_copies_near_copies_and_others():
    prints = {t: piecewise.fingerprint((t or "").encode()) for _, t in ROWS}
    long = next(t for _, t in ROWS if t and len(t) > 20000)
    assert piecewise.likeness(prints[long], prints[long]) == 1.0
    assert piecewise.likeness(prints[long], prints[long + " end"]) > 0.9
    others = [t for _, t in ROWS if t and 200 < len(t) < 2000][:8]
    assert all(piecewise.likeness(prints[a], prints[b]) == 0 for a, b in zip(others, others[1:]) if not a.startswith(b[:20]) and len(set(a.split()) & set(b.split())) < 5)
    assert piecewise.fingerprint(b"") == "3::"
    short = b"the quick brown fox jumps"
    assert piecewise.likeness(piecewise.fingerprint(short), piecewise.fingerprint(short[:17] + b"colours!")) > 0.3
    for text in (b"a", b"ab" * 5000, bytes(range(256)) * 9):
        block, one, two = piecewise.fingerprint(text).split(":")
        assert int(block) % 3 == 0 and len(one) <= 64 and len(two) <= len(one)


def test_whole_text_counts(llm):
    text = "".join(chr(97 + i * i % 26) for i in range(9000))
    assert piecewise.fingerprint(text.encode()) != piecewise.fingerprint((text[:-1] + "!").encode())


def test_lone_document_is_next_to_itself(llm):
    row = piecewise.fingerprints(llm.createDataFrame([(4, "some text here")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and row["edited_sha256"] == hashlib.sha256(b"some text some").hexdigest()


# ---------------------------------------------------------------- shards


def least_capacity(sizes, shards):
    def fits(c):
        used, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            used, held = (used + 1, s) if held + s > c else (used, held + s)
        return used <= shards

    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


@pytest.mark.parametrize("window_rows", [100_000, 0])
def test_shards_have_the_least_largest_size(documents, window_rows, monkeypatch):
    monkeypatch.setattr(sharding.cut_points, "__defaults__", (window_rows,))
    rows = sharding.shard_by_bytes(documents).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in ROWS)
    groups, shards, loads = Counter(), defaultdict(set), Counter()
    for r in rows:
        groups[r["group_key"]] += r["size"]
        shards[r["group_key"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) == least_capacity([groups[k] for k in sorted(groups)], 8)
    assert all(len(s) == 1 for s in shards.values()) and set(loads) <= set(range(8))
    for shard in loads:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


# ---------------------------------------------------------------- ORC


def test_orc_round_trip_and_pruned_lookup(llm, documents, tmp_path):
    ids = plain_ids("word_bpe_49k.json")
    orc_output.write_orc(documents, f"{tmp_path}/orc", public_tokenizers.path("word_bpe_49k.json"))
    read = orc_output.read_orc(llm, f"{tmp_path}/orc")
    expected = Counter((d, len(ids(t)), crc(ids(t))) for d, t in ROWS)
    rows = orc_output.digests(read).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == expected
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    known = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert known == sorted(known, key=lambda d: (d is not None, d or 0))
    found = orc_output.read_orc(llm, f"{tmp_path}/orc", [14, 500])
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    assert {(r["doc_id"], tuple(r["ids"])) for r in found.collect()} == {(d, tuple(ids(t))) for d, t in ROWS if d in (14, 500)}


# ---------------------------------------------------------------- packing


def test_packing_places_every_id_once(llm, documents, tmp_path):
    path, ids = public_tokenizers.path("byte_bpe_50k.json"), plain_ids("byte_bpe_50k.json")
    packing.write_sequences(documents, f"{tmp_path}/sequences", path, window=256, step=4)
    written = packing.read_sequences(llm, f"{tmp_path}/sequences")
    rows = packing.piece_digests(written).collect()
    expected = Counter()
    for d, t in ROWS:
        whole = ids(t)
        expected.update((d, s, len(whole[s : s + 256]), crc(whole[s : s + 256]), len(whole)) for s in range(0, len(whole), 256))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for inside in sequences.values():
        at = 0
        for r in sorted(inside, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= -(-total // 256) + max(3, total // 256 // 12)
    made = written.collect()
    assert len(made) == len(sequences)
    for m in made:
        inside = sorted(sequences[m["sequence_id"]], key=lambda r: r["offset"])
        used = sum(r["length"] for r in inside)
        assert [crc(m["ids"][r["offset"] : r["offset"] + r["length"]]) for r in inside] == [r["ids_crc32"] for r in inside]
        assert len(m["ids"]) == (used if used & (used - 1) == 0 else 256) and not any(m["ids"][used:])


def test_plan_places_all_pieces_with_little_padding():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 3000):
        classes = np.minimum(np.ceil(rng.lognormal(3.5, 1, n)).astype(int), 64)
        histogram = dict(zip(*(x.tolist() for x in np.unique(classes, return_counts=True)), strict=True)) if n else {}
        made = packing.plan(histogram, 64)
        placed = Counter()
        for combination, many in made:
            assert sum(combination) <= 64 and many > 0
            for k in combination:
                placed[k] += many
        assert placed == Counter(histogram)
        if n > 1000:
            assert classes.sum() / (64 * sum(m for _, m in made)) > 0.97


# ---------------------------------------------------------------- mixing



def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= cap * sizes[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_targets(documents):
    rows = mixing.mix(documents).collect()
    sizes = Counter({s: 0 for s in {r[3] for r in document_rows()}})
    for r in document_rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in document_rows())
    target = plain_targets(dict(sizes))
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["copies"] in (0, 1, 2) and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s, words in sizes.items():
        largest = max(len(WORD.findall(r[1] or "")) for r in document_rows() if r[3] == s)
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], min(largest, 60))
    again = mixing.mix(documents.repartition(5)).collect()
    key = lambda r: (str(r["doc_id"]), r["row_key"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_rates_solve_the_dual(llm):
    rows = [(i, "w " * (1 + i % 40), "a" if i % 3 else "b") for i in range(400)]
    mixed = mixing.mix(llm.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in mixed if r["source"] == source]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-3)
        # One multiplier for all documents of a source: log odds in proportion to the size.
        odds = {round(np.log(r["rate"] / (2 - r["rate"])) / r["size"], 9) for r in own if 0 < r["rate"] < 2}
        assert max(odds, default=0) - min(odds, default=0) < 1e-6


# ---------------------------------------------------------------- near duplicates


@pytest.mark.parametrize("hot_entries", [200_000, 2])
def test_components_match_all_pairs(documents, hot_entries, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 8)
    found = jaccard_join.near_duplicates(documents, hot_entries=hot_entries).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain_components(ROWS)


@pytest.mark.parametrize("hot_entries", [200_000, 2])
def test_components_of_chains_and_gray_groups(llm, hot_entries, monkeypatch):
    """Groups around one text at all distances, where hubs link some sets, and others link only to each other."""
    import random

    monkeypatch.setattr(jaccard_join, "SKETCH_BITS", 8)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "HEAD_ROWS", 5)
    monkeypatch.setattr(jaccard_join, "BUCKET_ENTRIES", 400)
    rng, rows = random.Random(11), []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(60)]
        for _ in range(45):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(60)] = f"n{rng.randrange(6)}"
            rows.append((len(rows), " ".join(text)))
        for step in range(12):
            rows.append((len(rows), " ".join([f"c{g}y{i}" for i in range(3 * step, 60 + 3 * step)])))
    found = jaccard_join.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string"), hot_entries=hot_entries).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == plain_components(rows)


def test_one_document_of_a_component_stays(documents):
    kept = jaccard_join.without_near_duplicates(documents)
    assert kept.columns == documents.columns
    components = plain_components(ROWS)
    named = Counter(r["doc_id"] for r in kept.collect())
    assert sum(named.values()) == len({c for _, n, c in components if n}) + sum(k for (_, n, _), k in components.items() if not n)


# ---------------------------------------------------------------- no rows


def test_empty_tables(llm, no_documents, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert piecewise.fingerprints(no_documents).isEmpty()
    assert sharding.shard_by_bytes(no_documents).isEmpty()
    assert packing.pack(no_documents, path).isEmpty()
    assert mixing.mix(no_documents).isEmpty() and mixing.mixed(no_documents).isEmpty()
    assert jaccard_join.near_duplicates(no_documents).isEmpty() and jaccard_join.without_near_duplicates(no_documents).isEmpty()
    orc_output.write_orc(no_documents, f"{tmp_path}/orc", path)
    assert orc_output.digests(orc_output.read_orc(llm, f"{tmp_path}/orc")).isEmpty()


def test_mixed_repeats_rows(documents):
    mixed = mixing.mixed(documents)
    assert mixed.columns == documents.columns
    copies = mixing.mix(documents).agg(F.sum("copies")).first()[0]
    assert mixed.count() == copies
