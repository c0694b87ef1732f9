"""Near duplicates by tensored banding against all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_rows import document_rows, plain_components

from lagcast.llm import jaccard_join, tensor_minhash
from lagcast.llm.common import mix


def found_rows(docs):
    rows = tensor_minhash.near_duplicates(docs).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows)


def test_components_match_all_pairs(documents):
    assert found_rows(documents) == plain_components([(r[0], r[1]) for r in document_rows()], 3, 85)


def test_chains_and_groups_around_one_text(llm, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 8)
    monkeypatch.setattr(jaccard_join, "HEAD_ROWS", 5)
    rng, rows = random.Random(4), []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(90)]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randrange(0, 5)):
                text[rng.randrange(90)] = f"n{rng.randrange(6)}"
            rows.append((len(rows), " ".join(text)))
        for step in range(12):
            rows.append((len(rows), " ".join(f"c{g}y{i}" for i in range(4 * step, 90 + 4 * step))))
    rows += [(None, rows[0][1]), (None, "only two"), (None, None), (3, rows[3][1]), (3, rows[3][1])]
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert found_rows(docs) == plain_components(rows, 3, 85)


def test_bands_meet_as_the_likeness_of_sets_says():
    """Shares of equal minhashes estimate the Jaccard likeness; equal sets have equal bands."""
    rng = np.random.default_rng(1)
    pool = mix(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    one, two = np.unique(pool[:2000]), np.unique(pool[500:2500])
    made = tensor_minhash.band_hashes([one, two, one], bands=300, rows=1)
    assert (made[:, :, 0] == made[:, :, 2]).all()
    assert abs((made[:, :, 0] == made[:, :, 1]).mean() - 1500 / 2500) < 0.06


def test_regular_words_do_not_collide():
    """Two different words of 4096 letters whose sums of powers modulo 2**64 are equal."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    column = pa.array([word, word.translate(str.maketrans("ab", "ba")), word + " x", word])
    a, b, c, d = jaccard_join.shingle_sets(column, 3)
    assert a.tolist() != b.tolist() and a.tolist() == d.tolist() and c.tolist() != a.tolist()


def test_no_documents(no_documents):
    assert tensor_minhash.near_duplicates(no_documents).count() == 0


def test_regular_chunks_get_their_own_ids():
    """The same for chunks of the tokenizers."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from lagcast.llm.tokens import Encoder

    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), "x " + word + " y"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        ids, stops = Encoder(public_tokenizers.path(name)).column(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(stops[:-1], stops[1:], strict=True)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_longer_than_a_block(monkeypatch):
    from lagcast.llm import common

    monkeypatch.setattr(common, "BLOCK", 64)
    texts = ["x" * 300 + " ab cd", "", "  ", "ab", "cd" + "y" * 200, "z" * 64 + " " + "z" * 65, "ab" * 40, "cd ab"]
    whole = [jaccard_join.word_hashes(pa.array([t]))[0].tolist() for t in texts]
    hashes, begins = jaccard_join.word_hashes(pa.array(texts))
    assert [hashes[a:b].tolist() for a, b in zip(begins[:-1], begins[1:], strict=True)] == whole
    monkeypatch.setattr(common, "BLOCK", 1 << 19)
    assert [jaccard_join.word_hashes(pa.array([t]))[0].tolist() for t in texts] == whole
    assert [len(w) for w in whole] == [3, 0, 0, 1, 1, 2, 1, 2]
