"""Scores of all variants at one connection and time slot, as sums over dense delay grids.

Delays are whole minutes in a fixed range, so what a state sees is a small matrix of weights by
previous and final delay.  A live report weighs its rows: all reports of a state are one matrix
product, and no observation is paired with runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from lagcast import params as P
from lagcast.operators.distribution import SHARE_DIGITS

CELL = ["day", "weekday", "holiday_class", "tod", "prev", "final", "n", "asked"]
SCORES = ["crps", "pinball10", "pinball50", "pinball90", "covered80"]
BLIND, LIVE = 0, 1


def scored(weights: np.ndarray, values: np.ndarray, rows: np.ndarray, y: np.ndarray, shift=0) -> np.ndarray:
    """Scores ``(SCORES, observation)`` of weightings of ascending values moved by ``shift``; NaN where nothing has weight.

    ``rows`` names the weighting of each observation.  The distance to ``y`` is read off the running sums.
    """
    moments = weights * values
    total, cum, moment = weights.sum(1), np.cumsum(weights, 1), np.cumsum(moments, 1)
    some = total > 0
    safe = np.where(some, total, 1.0)
    spread = (moments * (2 * cum - weights - total[:, None])).sum(1) / (safe * safe)
    share = cum / safe[:, None]
    # Least value whose share, rounded, reaches p.
    q10, q50, q90 = (values[np.argmax(share >= p - 0.5 * 10.0**-SHARE_DIGITS, 1)][rows] + shift for p in (0.1, 0.5, 0.9))
    at = np.searchsorted(values, y - shift, "right") - 1
    below, far = np.where(at < 0, 0.0, cum[rows, at]), np.where(at < 0, 0.0, moment[rows, at])
    distance = ((y - shift) * (2 * below - total[rows]) + moment[rows, -1] - 2 * far) / safe[rows]
    pinballs = [np.where(y < q, (1 - p) * (q - y), p * (y - q)) for q, p in ((q10, 0.1), (q50, 0.5), (q90, 0.9))]
    out = np.array([distance - spread[rows], *pinballs, (y >= q10) & (y <= q90)])
    return np.where(some[rows], out, np.nan)


def likeness(prev: np.ndarray, live: np.ndarray, factor: float) -> np.ndarray:
    """``functions.delays.likeness`` without its floor, for every pair of a report and a previous delay."""
    z = (prev[None, :] - live[:, None]) / np.maximum(P.KERNEL_MIN_BANDWIDTH, factor * np.abs(live))[:, None]
    return np.exp(-0.5 * z * z)


class Place:
    """Runs of one connection near one time slot, ordered by day."""

    def __init__(self, cells: pa.Table, variants, bases: list[tuple]):
        order = np.argsort(cells["day"].to_numpy(), kind="stable")
        known = cells["prev"].is_valid().to_numpy()[order]
        col = {c: (cells[c].fill_null(0) if c == "prev" else cells[c]).to_numpy()[order] for c in CELL}
        self.variants, self.bases = variants, bases
        self.day, self.n, self.asked, self.known = col["day"], col["n"].astype(float), col["asked"], known
        self.weekday, self.holiday_class = col["weekday"], col["holiday_class"]
        self.prev, self.final = col["prev"], col["final"]
        self.finals, self.final_at = np.unique(self.final, return_inverse=True)
        self.tods, self.tod_at = np.unique(col["tod"], return_inverse=True)
        # Unknown previous delays have the last row of a matrix.
        self.prevs, prev_at = np.unique(self.prev[known], return_inverse=True)
        self.prev_at = np.full(len(order), len(self.prevs))
        self.prev_at[known] = prev_at
        self.moves, self.move_at = np.unique(self.final - self.prev, return_inverse=True)

    def weights(self, day: int, end: int) -> list[np.ndarray]:
        """Weights of the runs before a day, per base."""
        age, here = day - self.day[:end], np.searchsorted(self.day, day)
        out = []
        for half_life, boost, holiday, window in self.bases:
            w = np.exp2(-np.arange(age[0] + 1) / half_life)[age]
            if window is not None:
                w = w * (age <= window)
            if boost != 1.0:
                kind = self.holiday_class if holiday else self.weekday
                w = w * np.where(kind[:end] == kind[here], boost, 1.0)
            out.append(w)
        return out

    def scores(self) -> Iterator[tuple]:
        """Per evaluation state ``(day, tod, live or none, y, c, variant, scenario, scores)`` columns."""
        for day in np.unique(self.day[self.asked]):
            end, after = np.searchsorted(self.day, [day, day + 1])
            if not end:
                continue
            past, grid = self.weights(day, end), (len(self.tods), len(self.finals))
            spot, n = self.tod_at[:end] * grid[1] + self.final_at[:end], self.n[:end]
            sums = [n, n * self.known[:end], *[n * w for w in past]]
            by_tod = np.array([np.bincount(spot, s, grid[0] * grid[1]).reshape(grid) for s in sums])
            now = end + np.flatnonzero(self.asked[end:after])
            for at in np.unique(self.tod_at[now]):
                tod = self.tods[at]
                low, high = np.searchsorted(self.tods, [tod - P.TOD_WINDOW, tod + P.TOD_WINDOW + 1])
                near = by_tod[:, low:high].sum(1)
                if near[0].sum() >= P.MIN_HISTORY:
                    of_state = now[self.tod_at[now] == at]
                    inside = np.flatnonzero((self.tod_at[:end] >= low) & (self.tod_at[:end] < high))
                    yield from self.state(day, tod, of_state, near, inside, past)

    def state(self, day, tod, own, near, inside, past) -> Iterator[tuple]:
        y, count, told = self.final[own], self.n[own], self.known[own]
        every = np.zeros(len(own), int)
        # Blind scores of each base; they serve live rows too where nothing better is known.
        blind = dict(zip(self.bases, (scored(w[None, :], self.finals, every, y) for w in near[2:])))
        yield from ((day, tod, own, v, BLIND, s) for v, s in ((v, blind[x.base()]) for v, x in enumerate(self.variants)))
        if not told.any():
            return
        own, y = own[told], y[told]
        lives, rows = np.unique(self.prev[own], return_inverse=True)
        enough = near[1].sum() >= P.MIN_EFFECTIVE_N
        base_at = {b: i for i, b in enumerate(self.bases)}
        for v, x in enumerate(self.variants):
            plain = blind[x.base()][:, told]
            if x.factor is None:
                better = None
            elif x.mode == "delta":
                better = self.delta(x, past[base_at[x.base()]], inside, lives, rows, y) if enough else None
            else:
                better = self.kernel(x, past[base_at[x.base()]], inside, lives, rows, y, plain)
            yield day, tod, own, v, LIVE, plain if better is None else better

    def delta(self, variant, weight, inside, lives, rows, y) -> np.ndarray:
        """Final delays as moves from the previous one, laid on the live report."""
        inside = inside[self.known[inside]]
        shape = (len(self.prevs), len(self.moves))
        spot = self.prev_at[inside] * shape[1] + self.move_at[inside]
        moved = np.bincount(spot, self.n[inside] * weight[inside], shape[0] * shape[1]).reshape(shape)
        if variant.factor > 0:
            return scored((P.KERNEL_FLOOR + likeness(self.prevs, lives, variant.factor)) @ moved, self.moves, rows, y, lives[rows])
        return scored(moved.sum(0)[None, :], self.moves, np.zeros_like(rows), y, lives[rows])

    def kernel(self, variant, weight, inside, lives, rows, y, plain) -> np.ndarray:
        """Weights sharpened by likeness, where enough of them is left."""
        shape = (len(self.prevs) + 1, len(self.finals))
        at, w, n = self.prev_at[inside], weight[inside], self.n[inside]
        seen = np.bincount(at * shape[1] + self.final_at[inside], n * w, shape[0] * shape[1]).reshape(shape)
        like = np.hstack([likeness(self.prevs, lives, variant.factor), np.full((len(lives), 1), P.KERNEL_UNKNOWN)])
        mass, square = like @ np.bincount(at, n, shape[0]), (like * like) @ np.bincount(at, n * w * w, shape[0])
        sharp = like @ seen
        total = sharp.sum(1)
        trusted = (mass >= P.MIN_EFFECTIVE_N) & (total * total >= P.MIN_EFFECTIVE_N * square) & (square > 0)
        return np.where(trusted[rows], scored(sharp, self.finals, rows, y), plain)


def score_batches(keys: list, cells: pa.Table, variants, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``schema`` for one connection and slot, some thousand at a time."""
    if not cells["asked"].to_numpy().any():
        return
    bases = list(dict.fromkeys(v.base() for v in variants))
    place, held, size = Place(cells, variants, bases), [], 0
    for part in place.scores():
        held.append(part)
        size += len(part[2])
        if size >= 50_000:
            yield _batch(keys, place, held, schema)
            held, size = [], 0
    if held:
        yield _batch(keys, place, held, schema)


def _batch(keys: list, place: Place, parts: list, schema: pa.Schema) -> pa.RecordBatch:
    lengths = [len(p[2]) for p in parts]
    day, tod, variant, scenario = (np.repeat([p[i] for p in parts], lengths) for i in (0, 1, 3, 4))
    own, scores = np.concatenate([p[2] for p in parts]), np.concatenate([p[5] for p in parts], axis=1)
    some = ~np.isnan(scores[0])
    own, scores, day, tod, variant, scenario = own[some], scores[:, some], day[some], tod[some], variant[some], scenario[some]
    live = pa.array(place.prev[own], mask=~place.known[own])
    columns = [variant, scenario, *[pa.repeat(k, len(own)) for k in keys], pa.array(day, pa.int32()), tod, live, place.final[own], place.n[own].astype(int), *scores[:4], scores[4] > 0]
    made = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(made, schema)], schema=schema)
