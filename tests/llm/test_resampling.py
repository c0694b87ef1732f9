"""Importance resampling with Arrow kernels against plain sums, and its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lagcast.llm.ngram_resampling import OP12_SQL, drawn_documents, features, resample

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCHMARK = "item_id long, text string"


def runs(text, most):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def plain(docs, target, most, percent, least, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in side for f in runs(text, most)[1]) for side in ([d[1] for d in docs], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets))))
    rows = []
    for doc_id, text in docs:
        words, made = runs(text, most)
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in made)
        rows.append([doc_id, len(made), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=repr)


TARGET = ["abc Def ghi", None, "", "x x x x", "日本語 é É 42", "it's a TEST"]


@pytest.mark.parametrize(("most", "percent", "least"), [(1, 30, 5), (3, 50, 0)])
def test_resampling_equals_plain_sums(llm, documents, most, percent, least):
    target = llm.createDataFrame(list(enumerate(TARGET)), BENCHMARK)
    made = resample(documents, target, most=most, percent=percent, least_words=least)
    got = sorted((tuple(r) for r in made.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    docs = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert got == plain(docs, TARGET, most, percent, least)


def test_sql_of_resampling_equals_plain_sums():
    rng = random.Random(5)
    texts = [None, "", "A b-C 9"] + [" ".join(rng.choice("aBc é Ü 77 xyz q_r".split()) for _ in range(rng.randrange(40))) for _ in range(60)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    db.executemany("INSERT INTO benchmark VALUES (?, ?)", list(enumerate(TARGET)))
    assert sorted(db.execute(OP12_SQL).fetchall(), key=repr) == plain(list(enumerate(texts)), TARGET, 1, 10, 20)


def test_features_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choices("ab,. é9A", k=rng.randrange(200))) for _ in range(50)] + [None, "", ",,,", "x" * 100 + " y"]
    from lagcast.llm import ngram_resampling as module

    cut = module.pieces
    monkeypatch.setattr(module, "pieces", lambda column, most: cut(column, most, 20))
    for column in (pa.array(texts), pa.array(texts).slice(7, 40)):
        counted = Counter()
        for bucket, index, rows in features(column, 3, 10_000):
            counted.update(zip(rows.tolist(), bucket[index].tolist(), strict=True))
        expected = Counter((i, zlib.crc32(f.encode()) % 10_000) for i, text in enumerate(column.to_pylist()) for f in runs(text, 3)[1])
        assert counted == expected


def test_empty_tables(llm, documents, no_documents):
    target = llm.createDataFrame([], BENCHMARK)
    assert resample(no_documents, target).count() == 0
    assert drawn_documents(no_documents, target).columns == no_documents.columns
    weights = [r.weight for r in resample(documents, target).collect()]
    assert len(weights) == documents.count()


def test_drawn_documents_are_rows_of_the_input(llm, documents):
    target = llm.createDataFrame(list(enumerate(TARGET)), BENCHMARK)
    ranked = resample(documents, target, percent=50, least_words=1).where("rank IS NOT NULL")
    drawn = drawn_documents(documents, target, percent=50, least_words=1)
    assert drawn.columns == documents.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r.doc_id for r in ranked.collect())
    assert np.isfinite([r.weight for r in ranked.collect()]).all()
