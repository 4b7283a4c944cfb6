"""Swapping single rows between tuples while the weighted distance to a release falls.

A family's constraint c, met by h rows and wanting t, costs w * |h - t|. With d
for h - t, taking a row away gains w * (|d| - |d - 1|), adding one gains
w * (|d| - |d + 1|). Half the difference of the two is the slope G of c; their
sum is minus a curve S, which is 0 unless d is within 1. A swap from tuple i to
tuple j gains the slopes of i less those of j, less half the curves of all
constraints that only one of them meets: at most g(i) - g(j), where g is a
tuple's sum of slopes. So the best swap is sought among the tuples with rows and
the largest g and those with room and the smallest. Slopes far from their target
don't move with a swap, so the lists stay good for many swaps: they are drawn
anew only when a tuple outside might do better.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dpspark import domains
from dpspark.plans.spread import table_of
from dpspark.sources.tables import kept

#: Tuples on either list at first; a gain that counts; places to which gains are compared.
LISTED, EPSILON, PLACES = 2048, 1e-9, 9
#: Of a pool in Spark, the most tuples on either list: beyond it the search ends with what is listed.
LISTED_MOST = 65_536


@dataclass
class Listed:
    """Tuples in their order. of: families x tuples, -1: none; above, below: the largest g of a taken, the smallest of a roomy tuple that is not listed."""

    key: list
    of: np.ndarray
    size: np.ndarray
    taken: np.ndarray
    known: np.ndarray
    above: float
    below: float


class Pool(Protocol):
    def listed(self, slopes: list[np.ndarray], most: int) -> Listed: ...
    def move(self, key, by: int) -> None: ...


class Held:
    """A pool of arrays."""

    most = None

    def __init__(self, of: np.ndarray, size: np.ndarray, taken: np.ndarray, known: np.ndarray):
        self.of, self.size, self.taken, self.known = of, size, taken.copy(), known

    def listed(self, slopes: list[np.ndarray], most: int) -> Listed:
        g = potential(slopes, self.of)
        full, room = np.flatnonzero(self.taken > 0), np.flatnonzero((self.taken < self.size) & self.known)
        pick, above, below = [full, room], -np.inf, np.inf
        if len(full) > most:
            order = full[np.argpartition(-g[full], most)]
            pick[0], above = order[:most], float(g[order[most:]].max())
        if len(room) > most:
            order = room[np.argpartition(g[room], most)]
            pick[1], below = order[:most], float(g[order[most:]].min())
        at = np.union1d(*pick)
        return Listed(at.tolist(), self.of[:, at], self.size[at], self.taken[at], self.known[at], above, below)

    def move(self, key: int, by: int) -> None:
        self.taken[key] += by


class Spread:
    """A pool in Spark: one row a tuple, with ``by``, ``_n`` and ``_taken``."""

    most = LISTED_MOST

    def __init__(self, rows: DataFrame, by: Sequence[str], of: Sequence[Column], known: Column):
        self.rows, self.by, self.of, self.known = rows, list(by), list(of), known
        self.moved: dict[tuple, int] = {}

    def current(self) -> DataFrame:
        """The rows with all moves so far."""
        if self.moved:
            kinds = dict(self.rows.dtypes)
            frame = domains.frame(self.rows.sparkSession, [(*k, v) for k, v in self.moved.items()], ", ".join(f"{c} {kinds[c]}" for c in self.by) + ", _by int")
            rows = self.rows.join(F.broadcast(frame), self.by, "left")
            self.rows = kept(rows.withColumn("_taken", F.col("_taken") + F.coalesce("_by", F.lit(0))).select(self.rows.columns))
            self.moved = {}
        return self.rows

    def listed(self, slopes: list[np.ndarray], most: int) -> Listed:
        g = sum((F.coalesce(table_of(s, at), F.lit(0.0)) for s, at in zip(slopes, self.of, strict=True)), F.lit(0.0))
        rows = self.current().select(*self.by, "_n", "_taken", *(at.alias(f"_of{k}") for k, at in enumerate(self.of)), self.known.alias("_known"), g.alias("_g"))
        full = rows.where("_taken > 0").orderBy(F.desc("_g"), *self.by).limit(most + 1).collect()
        room = rows.where("_taken < _n AND _known").orderBy("_g", *self.by).limit(most + 1).collect()
        above, below = (found[most]["_g"] if len(found) > most else end for found, end in ((full, -np.inf), (room, np.inf)))
        found = sorted({tuple(r[c] for c in self.by): r for r in [*full[:most], *room[:most]]}.items())
        of = np.array([[r[f"_of{k}"] for _, r in found] for k in range(len(self.of))], int).reshape(len(self.of), len(found))
        return Listed([k for k, _ in found], of, *(np.array([r[c] for _, r in found]) for c in ("_n", "_taken", "_known")), above, below)

    def move(self, key: tuple, by: int) -> None:
        self.moved[key] = self.moved.get(key, 0) + by


def potential(values: list[np.ndarray], of: np.ndarray) -> np.ndarray:
    return sum((np.where(at >= 0, v[at], 0.0) for v, at in zip(values, of, strict=True)), np.zeros(of.shape[1]))


def curves(have: list[np.ndarray], found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(slopes, half curves) of every family; constraints without a target have neither."""
    slopes, half = [], []
    for h, (target, weight) in zip(have, found, strict=True):
        w, d = np.where(np.isnan(target), 0.0, weight), h - np.where(np.isnan(target), 0.0, target)
        slopes.append(w * (np.abs(d + 1) - np.abs(d - 1)) / 2)
        half.append(w * np.maximum(0.0, 1 - np.abs(d)))
    return slopes, half


def best_pair(x: Listed, slopes: list[np.ndarray], half: list[np.ndarray]) -> tuple[float, int, int]:
    """The swap with the largest gain, to ``PLACES`` places; of equal ones the first (from, to)."""
    g, h = potential(slopes, x.of), potential(half, x.of)
    own = [np.where(at >= 0, s[at], 0.0) for s, at in zip(half, x.of, strict=True)]
    room = np.flatnonzero((x.taken < x.size) & x.known)
    room = room[np.argsort(g[room], kind="stable")]
    full = np.flatnonzero(x.taken > 0)
    best = (-np.inf, -1, -1)
    if not len(room):
        return best
    for i in full[np.argsort(-g[full], kind="stable")].tolist():
        if g[i] - g[room[0]] < best[0] - EPSILON:
            break
        near = room[: np.searchsorted(g[room], g[i] - best[0] + EPSILON, side="right")] if best[1] >= 0 else room
        gain = (g[i] - h[i]) - (g[near] + h[near])
        for at, s in zip(x.of, own, strict=True):
            if s[i]:
                gain = gain + np.where(at[near] == at[i], 2 * s[i], 0.0)
        gain = np.where(near == i, -np.inf, np.round(gain, PLACES))
        top = gain.max(initial=-np.inf)
        if top > -np.inf and top >= best[0]:
            j = int(near[gain == top].min())
            if top > best[0] or (i, j) < best[1:]:
                best = float(top), i, j
    return best


def best_single(x: Listed, slopes: list[np.ndarray], half: list[np.ndarray], by: int) -> tuple[float, int]:
    """The tuple that gains most by one row more (``by`` 1) or less (-1)."""
    fit = np.flatnonzero((x.taken < x.size) & x.known if by > 0 else x.taken > 0)
    if not len(fit):
        return -np.inf, -1
    gain = np.round(-by * potential(slopes, x.of) - potential(half, x.of), PLACES)[fit]
    return float(gain.max()), int(fit[gain.argmax()])


def refine(pool: Pool, found: list[tuple[np.ndarray, np.ndarray]], have: list[np.ndarray], short: int, most: int) -> int:
    """Moves rows of ``pool``: first as many as are ``short`` (or too many, if below 0), then by up to ``most`` swaps, the best each time.

    found: (target, weight) of each family; have: rows that meet each constraint.
    Returns how many rows are still missing because no tuple has room.
    """
    listed, drawn, size, swaps = None, None, LISTED, 0
    while short or swaps < most:
        slopes, half = curves(have, found)
        if listed is None:
            listed, drawn = pool.listed(slopes, size), slopes
        # what slopes have gained and lost since the lists were drawn
        up, down = (sum(float(np.max(s * (a - b), initial=0.0)) for a, b in zip(slopes, drawn, strict=True)) for s in (1, -1))
        above, below = listed.above + up, listed.below - down
        g = potential(slopes, listed.of)
        full, room = g[listed.taken > 0].max(initial=-np.inf), g[(listed.taken < listed.size) & listed.known].min(initial=np.inf)
        if short:
            sign = 1 if short > 0 else -1
            gain, k = best_single(listed, slopes, half, sign)
            outside, moves = (-below if sign > 0 else above), [(k, sign)]
        else:
            gain, i, k = best_pair(listed, slopes, half)
            outside, moves = max(above - min(room, below), full - below), [(i, -1), (k, 1)]
        whole = np.isneginf(listed.above) and np.isposinf(listed.below)
        if not whole and outside >= gain - 2 * EPSILON and (short or outside > EPSILON):
            if drawn is not slopes:
                listed = None
                continue
            if pool.most is None or size < pool.most:
                listed, size = None, size * 4
                continue
        if k < 0 or (not short and gain <= EPSILON):
            if drawn is not slopes and not whole:
                listed = None
                continue
            break
        for at, by in moves:
            pool.move(listed.key[at], by)
            listed.taken[at] += by
            for h, of in zip(have, listed.of, strict=True):
                if of[at] >= 0:
                    h[of[at]] += by
        short, swaps = (short - moves[0][1], swaps) if short else (0, swaps + 1)
    return short
