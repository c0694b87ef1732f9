"""Token ids of whole texts by the tokenizers library, looked up chunk by chunk in array operations.

The public tokenizers cut a text before white space that follows another character, and
before ASCII punctuation that follows an ASCII letter; nothing left of such a place
changes the ids to its right. So ids of a text are those of its chunks. A block's chunks
are hashed together, and each distinct chunk is looked up, or encoded once and kept by
the worker. Rows with white space beyond blank, tab and line ends are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np

from lagcast.llm.common import BLOCK, LONG, SAME, digest64, mix, powers, utf8, worker_state

#: Distinct chunks that a worker keeps; then it starts anew.
KEPT, SLOT_BITS = 1_500_000, 22
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: First bytes of other white space and of controls that some consider white space.
RARE = np.zeros(256, bool)
RARE[[0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True


def odd_places(data: np.ndarray) -> np.ndarray:
    """Places of white space other than blank, tab and line ends (of a few characters beside it, too)."""
    at = np.flatnonzero(RARE[data])
    if not len(at):
        return at
    one, two, three = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
    odd = one < 0x20
    odd |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    odd |= (one == 0xE1) & ((two == 0x9A) | (two == 0xA0))
    odd |= (one == 0xE2) & (((two == 0x80) & ((three < 0x90) | (three >= 0xA8))) | (two == 0x81))
    odd |= ((one == 0xE3) & (two == 0x80)) | ((one == 0xEF) & (two == 0xBB))
    return at[odd]


#: One word of letters of ASCII and Latin-1 with at most one blank before it: a single piece for both tokenizers.
PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
#: How byte-level vocabularies write the bytes of such words.
BYTE_NAMES = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
BYTE_NAMES |= {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in BYTE_NAMES)}


class Encoder:
    """Ids of Arrow string columns; one per worker and tokenizer file."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model
        self.folds = spec["normalizer"] is not None
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.clear()

    def clear(self) -> None:
        # Open addressing: a slot holds the number of a chunk, a full slot passes it on to the next one.
        self.slots, self.known = np.full(1 << SLOT_BITS, -1, np.int32), 0
        self.hashes, self.starts, self.counts = np.zeros(1 << 14, np.uint64), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each chunk, or -1."""
        found = np.full(len(hashes), -1, np.int32)
        left = np.arange(len(hashes))
        slot = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(left):
            number = self.slots[slot]
            hit = self.hashes[number] == hashes[left]
            hit &= number >= 0
            found[left[hit]] = number[hit]
            on = (number >= 0) & ~hit
            left, slot = left[on], (slot[on] + 1) & ((1 << SLOT_BITS) - 1)
        return found

    def chunk(self, raw: bytes) -> list[int]:
        text = raw.decode("utf-8", "replace")
        if plain := PLAIN.fullmatch(text):
            word = (plain[2].lower() if self.folds else text) if not self.spaced or self.folds else text
            return [t.id for t in self.model.tokenize("".join(map(BYTE_NAMES.__getitem__, word.encode())))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, hashes: np.ndarray, chunks: list[bytes]) -> None:
        made = [self.chunk(c) for c in chunks]
        n, counts = len(made), np.fromiter(map(len, made), np.int64, len(made))
        total = int(counts.sum())
        if self.known + n > len(self.hashes):
            self.hashes, self.starts, self.counts = (np.concatenate((x, np.zeros(len(x) + n, x.dtype))) for x in (self.hashes, self.starts, self.counts))
        if self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros(len(self.ids) + total, np.uint32)))
        new = slice(self.known, self.known + n)
        self.hashes[new], self.counts[new], self.starts[new] = hashes, counts, self.used + np.cumsum(counts) - counts
        self.ids[self.used : self.used + total] = np.fromiter((i for ids in made for i in ids), np.uint32, total)
        for number, slot in enumerate((hashes >> np.uint64(64 - SLOT_BITS)).tolist(), self.known):
            while self.slots[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            self.slots[slot] = number
        self.known += n
        self.used += total

    @staticmethod
    def cuts(data: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Whether a chunk begins at each place after the first."""
        space = SPACE[data]
        return (space[1:] & ~space[:-1]) | (PUNCT[data[1:]] & LETTER[data[:-1]]) | edge[1:]

    def block(self, data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the chunks of a block, where each chunk begins, and how many ids it has."""
        cut = np.empty(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = self.cuts(data, edge)
        cuts = np.flatnonzero(cut)
        starts, ends = cuts[:-1], cuts[1:]
        hashes = np.zeros(len(starts), np.uint64)
        if len(data) <= BLOCK:
            up, down = powers(len(data))
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((SAME[data].astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * down[starts])
        for i in np.flatnonzero(ends - starts > LONG):
            hashes[i] = digest64(data[int(starts[i]) : int(ends[i])].tobytes())
        found = self.find(hashes)
        if len(new := np.flatnonzero(found < 0)):
            distinct, first = np.unique(hashes[new], return_index=True)
            if self.known + len(distinct) > KEPT:
                self.clear()
                new, (distinct, first) = np.arange(len(hashes)), np.unique(hashes, return_index=True)
            raw = data.tobytes()
            self.learn(distinct, [raw[starts[i] : ends[i]] for i in new[first]])
            found[new] = self.find(hashes[new])
        counts = self.counts[found].astype(np.int64)
        stops = np.cumsum(counts)
        pick = np.arange(int(stops[-1]) if len(stops) else 0) + np.repeat(self.starts[found] - (stops - counts), counts)
        return self.ids[pick], starts, counts

    def column(self, column, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows after one another, each row's followed by the id `end`, and the rows' offsets."""
        data, offsets = utf8(column)
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        low, high = int(offsets[0]), int(offsets[-1])
        odd = np.zeros(len(offsets) - 1, bool)
        if high > low:
            odd[np.searchsorted(offsets, low + odd_places(data[low:high]), "right") - 1] = True
        parts, begins, sizes, at = [], [], [], low
        while at < high:
            to = min(at + BLOCK, high)
            if to < high:
                # Blocks end where a chunk ends; a longer chunk is a block of its own.
                stops = np.flatnonzero(self.cuts(data[at : to + 1], edge[at : to + 1]))
                if len(stops):
                    to = at + 1 + int(stops[-1])
                while to < high and not len(stops):
                    on = min(to + BLOCK, high)
                    stops = np.flatnonzero(self.cuts(data[to - 1 : on], edge[to - 1 : on]))
                    to = to + int(stops[0]) if len(stops) else on
            ids, starts, counts = self.block(data[at:to], edge[at:to])
            parts.append(ids)
            begins.append(starts + at)
            sizes.append(counts)
            at = to
        ids, begins, sizes = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((parts, np.uint32), (begins, np.int64), (sizes, np.int64)))
        stops = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(begins, offsets)]
        if odd.any():
            rows = [ids[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)]
            for i in np.flatnonzero(odd):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                rows[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            ids, stops = np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))
        if end is not None:
            ids = np.insert(ids, stops[1:], np.uint32(end))
            stops = stops + np.arange(len(stops))
        return ids, stops


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file."""
    held = worker_state().setdefault("encoders", {})
    if path not in held:
        held[path] = Encoder(path)
    return held[path]
