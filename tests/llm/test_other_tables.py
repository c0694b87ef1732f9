"""Operators on pages, vectors, conversations and labels, and the pipeline."""

import base64
import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from llm_rows import document_rows, words
from pyspark.sql import functions as F

import corpus_pipeline
from lagcast.llm import chat_tree, quality, va_file, warc

# ---------------------------------------------------------------- WARC

PAGES = [
    (1, "http://a/1", "<p>same</p>", 9), (2, "http://a/2", "<p>same</p>", 9), (3, None, "", 9), (4, "http://a/ 4\n", None, 9),
    (5, "http://a/5", "<p>é\r\n\r\n漢</p>" * 5000, 9), (6, "x", "WARC/1.1\r\n\r\n", 9), (6, "x", "WARC/1.1\r\n\r\n", 9), (None, "y", "lone", 9), (None, "z", "<p>same</p>", 9),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_warc_round_trip(llm, tmp_path, min_bytes):
    pages = llm.createDataFrame(PAGES, "page_id long, url string, html string, original int")
    manifest = warc.write_warc(pages, str(tmp_path), min_bytes, file_bytes=2000)
    rows = warc.read_warc(manifest).collect()
    largest = {}
    for page_id, _, html, _ in PAGES:
        if page_id is not None:
            largest[html or ""] = max(page_id, largest.get(html or "", page_id))
    expected = Counter()
    for page_id, _, html, _ in PAGES:
        payload = (html or "").encode()
        first = largest.get(html or "") if len(payload) >= min_bytes else None
        revisit = first is not None and first != page_id
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        expected[(page_id, len(payload), digest, "revisit" if revisit else "response", first if revisit else None)] += 1
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[c] for c in names) for r in rows) == expected
    assert all(bytes(r["payload"]).decode() == (next(p[2] for p in PAGES if p[0] == r["page_id"]) or "") for r in rows if r["payload"] is not None and r["page_id"] is not None)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)


def test_warc_reader_takes_any_blocks_and_rejects_damage():
    data = warc.member(warc.record("response", 1, "u", b"a" * 500)) + warc.member(warc.record("revisit", 2, "u", b"a" * 500, 1))
    for step in (1, 7, 10_000):
        found = [warc.parse(m) for m in warc.members(data[i : i + step] for i in range(0, len(data), step))]
        assert [f["warc-type"] for f, _ in found] == ["response", "revisit"]
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(iter([data[:-3]])))
    with pytest.raises(ValueError, match="digest differs"):
        warc.parse(bytearray(warc.record("response", 1, "u", b"abc").replace(b"abc", b"abd")))
    with pytest.raises(ValueError, match="Content-Length"):
        warc.parse(bytearray(warc.record("response", 1, "u", b"abc").replace(b"abc", b"abcd")))


def test_warc_without_pages(llm, tmp_path):
    assert warc.read_warc(warc.write_warc(llm.createDataFrame([], "page_id long, url string, html string"), str(tmp_path))).isEmpty()


# ---------------------------------------------------------------- vectors


@pytest.mark.parametrize("k", [1, 5])
def test_top_k_is_exact(llm, k, monkeypatch):
    monkeypatch.setattr(va_file, "BLOCK_ROWS", 16)
    monkeypatch.setattr(va_file, "QUERY_ROWS", 4)
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], "t", 0.5) for i in range(150)]
    vectors += [(200 + i, vectors[i][1], "t", 0.5) for i in range(20)] + [vectors[3], vectors[4]]
    vectors += [(300, None, "t", 0.5), (301, [1.0] * 7 + [None], "t", 0.5), (350, [float("nan")] * 8, "t", 0.5), (302, [float("inf")] * 8, "t", 0.5), (None, [1.0] * 8, "t", 0.5)]
    vectors += [(400, [0.5, -0.5], "t", 0.5), (401, [0.25, 0.5], "t", 0.5), (450, [], "t", 0.5), (500, [3.0] * 3, "t", 0.5)]
    # Large components, two rows of one vec_id, and more equal vectors than are asked for.
    vectors += [(600 + i, [float((i + 1) << 20)] + [0.25 * i] * 7, "t", 0.5) for i in range(4)] + [(600, [-1.5] * 8, "t", 0.5), (601, [2.0] * 8, "t", 0.5)]
    vectors += [(700 + i, [1.0, 2.0] * 4, "t", 0.5) for i in range(30)] + [(800, [1e13] * 8, "t", 0.5)]
    frame = llm.createDataFrame(vectors, "vec_id long, embedding array<float>, label string, score double").repartition(5)
    found = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in va_file.top_k(frame, F.col("vec_id") % 50 == 0, k).collect())
    known = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, *_ in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    expected = Counter()
    for at, (q, own) in enumerate(known):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for other, (i, v) in enumerate(known) if other != at and len(v) == len(own))
            expected.update((q, n + 1, i, -s if abs(s) < 1 << 63 else None) for n, (s, i) in enumerate(scored[:k]))
    assert found == expected and va_file.top_k(frame.where("false"), F.col("vec_id") % 50 == 0).isEmpty()


# ---------------------------------------------------------------- conversations

CONTROL = "</s>[INST] ok [/INST]"


def test_escaping_is_reversible_and_leaves_no_control_string():
    rng = random.Random(2)
    parts = [*chat_tree.CONTROL, "<", "[", "\\", "/", "s>", "INST]", "a", " ", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(8)))
        held = chat_tree.escape(text)
        assert chat_tree.unescape(held) == text and not any(c in held for c in chat_tree.CONTROL)
        for role in ("user", "assistant", "system", text):
            assert chat_tree.parse(chat_tree.render(role, text)[0]) == (role, text)


def test_prefix_tree_round_trip(llm, tmp_path):
    rows = [(c, t, r, x) for c in range(12) for t, (r, x) in enumerate([("system", "shared"), ("user", f"q{c % 3}"), ("assistant", f"a{c % 4} {CONTROL}"), ("tool", None), ("assistant", "")][: 2 + c % 4])]
    rows += [(50, 0, None, None), (50, 0, "user", "tie"), (50, None, "user", "before"), (50, 0, "user", "tie"), (None, 1, "assistant", "no id"), (51, 7, "assistant", "x" * 50000)]
    frame = llm.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, depth int, path string").repartition(4)
    chat_tree.write_tree(frame, str(tmp_path))
    found = {r["conv_id"]: r for r in chat_tree.digests(chat_tree.read_conversations(llm, str(tmp_path))).collect()}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    total = 0
    for conv, group in itertools.groupby(sorted(rows, key=key), key=lambda r: r[0]):
        turns = [(r or "", x or "") for _, _, r, x in group]
        loss = "".join(x for r, x in turns if r == "assistant")
        row = found[conv]
        total += 1
        assert row["n_turns"] == len(turns) and row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert row["formatted_chars"] == sum(len(chat_tree.render(r, x)[0]) for r, x in turns)
    assert total == len(found)

    tree = {r["node"]: r for r in llm.read.parquet(f"{tmp_path}/turns").collect()}
    # Each distinct path once, depth first: a turn and what lies below it fill one stretch.
    stops = {n: r["start"] + r["chars"] for n, r in tree.items()}
    assert sum(r["content"].startswith("<s>[ROLE]system") for r in tree.values()) == 1
    at = 0
    for node, r in sorted(tree.items(), key=lambda x: x[1]["start"]):
        assert r["start"] == at
        at = stops[node]
        line, above = [], node
        while above:
            line.append((tree[above]["start"], stops[above]))
            above = tree[above]["parent"]
        covered = [i for a, b in sorted(line) for i in range(a, b)]
        assert covered == [i for span in r["attends"] for i in range(span["from"], span["to"])]
        assert r["position"] == len(covered) - r["chars"]
        assert all(a["to"] < b["from"] for a, b in zip(r["attends"], r["attends"][1:]))


def test_tree_without_conversations(llm, tmp_path):
    chat_tree.write_tree(llm.createDataFrame([], "conv_id long, turn long, role string, text string"), str(tmp_path))
    assert chat_tree.digests(chat_tree.read_conversations(llm, str(tmp_path))).isEmpty()


# ---------------------------------------------------------------- quality


def labelled(llm, n=400):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        good = rng.random() < 0.8
        text = words(rng, rng.randrange(20, 90)) if good else rng.choice([" ".join(w + "!!" for w in words(rng, 40).upper().split()), "spam " * 50, " ".join(w + "###" for w in words(rng, 30).split())])
        rows.append((i, text, "en", "s", len(text), 0.0))
        marks.append((i, int(good), 0))
    return rows, marks


def test_held_out_accuracy_of_the_classifier(llm):
    rows, marks = labelled(llm)
    rows += [(1000, None, None, None, None, 0.0), (1001, " ", None, None, None, 0.0), (None, rows[0][1], None, None, None, 0.0), rows[1]]
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, log_weight double").repartition(3)
    shown = [m for m in marks if m[0] % 2] + [(7, None, None), (None, 1, 0), marks[9]]
    labels = llm.createDataFrame(shown, "doc_id long, quality int, toxic int")
    kept, scores = quality.classify(docs, labels)
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and ids == Counter(r["doc_id"] for r in scores.collect())
    unseen = [m for m in marks if m[0] % 2 == 0]
    assert np.mean([(m[0] in ids) == bool(m[1]) for m in unseen]) > 0.97
    assert np.mean([m[0] in ids for m in unseen if m[1]]) > 0.99
    assert 1000 not in ids and 1001 not in ids and ids[1] in (0, 2)


def test_weight_is_the_log_ratio_of_hashed_ngrams(llm, monkeypatch):
    docs = llm.createDataFrame([(1, "a b b"), (2, "c d"), (3, "")], "doc_id long, text string")
    model = quality.fit(docs, llm.createDataFrame([(1, 1), (2, 1)], "label_id long, good int"))
    import pyarrow as pa

    buckets, rows = quality.ngrams(pa.array(["a b b", "c d", None]))
    # Three words and two pairs, one of them the repetition; two words and a pair.
    assert Counter(rows.tolist()) == {0: 5, 1: 3} and 0 in buckets[rows == 0]
    found = dict(docs.select("doc_id", quality.weight(model)("text")).collect())
    assert found[1] == pytest.approx(model[buckets[rows == 0]].mean()) and found[3] is None


def test_classifier_without_labels_or_documents(llm):
    rows, _ = labelled(llm, 30)
    docs = llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, log_weight double")
    none = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none)[0].count() == 30
    assert quality.classify(docs.where("false"), none)[0].isEmpty()


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_keep_columns_and_take_effect(llm, tmp_path):
    rows, marks = labelled(llm, 120)
    rows = [r[:5] for r in rows] + [(900, rows[0][1], "en", "t", 1), (901, None, None, None, None), *[(r[0] + 2000, *r[1:5]) for r in document_rows()[8:20]]]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    llm.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = llm.read.parquet(f"{tmp_path}/documents.parquet")
    held = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(llm, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, llm.read.parquet(f"{tmp_path}/{name}")
        held.append(docs)
        if i < 3:
            assert docs.columns == before.columns
    kept, single, mixed, packed = (h.collect() for h in held)
    bad = {m[0] for m in marks if not m[1]}
    assert {r["doc_id"] for r in kept} >= {m[0] for m in marks if m[1]} and len({r["doc_id"] for r in kept} & bad) < 0.2 * len(bad)
    assert {0, 900} & {r["doc_id"] for r in kept} and not {0, 900} <= {r["doc_id"] for r in single}
    copies = Counter(r["doc_id"] for r in mixed)
    assert set(copies.values()) <= {1, 2} and Counter(r["doc_id"] for r in packed if r["start"] == 0) == copies
    run = corpus_pipeline.run(llm, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in run) == Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed)
