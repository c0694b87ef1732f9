"""Rows of every awkward kind."""

import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, start long, size int, head string, copies double, _key string"


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randrange(2, 7))) for _ in range(n))


def document_rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, and columns with clashing names."""
    rng = random.Random(3)
    long = words(rng, 6000)
    base = words(rng, 60).split()
    texts = [None, "", "   \n\t ", "Ein Wort", "ein wort", "a b c d", long, long + " end"]
    texts += [words(rng, rng.randrange(5, 80)) for _ in range(25)]
    texts += ["x" * 3000, "日本語 テキスト é", "it's  a\ttest\r\nof 42 things!! <s>[INST]", "\x0b odd\xa0space "]
    for i in range(14):
        changed = list(base)
        changed[rng.randrange(len(changed))] = f"new{i}"
        if i % 3 == 0:
            changed[rng.randrange(len(changed))] = f"other{i}"
        texts.append(" ".join(changed))
    rows = [(i * 7 % 101, t, "en", [None, "a", "b", "B", "c"][i % 5], None) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[0], (None, "no id at all but some words here", None, None, None), (None, None, None, "a", None)]
    rows += [(500, rows[12][1], "en", "a", 3), (501, rows[12][1], "en", "b", 3)]
    return [(*r, 1, 2, "h", 3.0, "k") for r in rows]


def plain_components(rows, k=5, percent=75):
    """(doc_id, size of the set, component) of each row by comparing all pairs."""
    sets, lower = [], str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[top(i)] = top(j)
    members = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        members[top(i)].append(d)
    lowest = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return Counter((d, len(s), lowest[top(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))
