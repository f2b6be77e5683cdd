"""Closest pairs of named numbers by their rounded difference, without listing all pairs; no Spark in here.

Pairs are ordered by (difference rounded to two digits, smaller name, larger name). Numbers are sorted, so the partners of one at a
given rounded difference are two ranges of places. A table of range maxima over the names tells which numbers have a partner with a
larger name, and only those are looked at, in the order of names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.rint(np.abs(x) * 100.0) / 100.0


def _first(low: np.ndarray, high: np.ndarray, holds: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place of each range [low, high) where a condition holds that goes on holding; high if none."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        good = holds(np.minimum(middle, len(low) - 1))
        low, high = np.where(open_ & ~good, middle + 1, low), np.where(open_ & good, middle, high)
    return low


class _Maxima:
    """Maxima of ranges by doubling."""

    def __init__(self, x: np.ndarray):
        self.rows = [x]
        while (step := 1 << (len(self.rows) - 1)) * 2 <= len(x):
            self.rows.append(np.maximum(self.rows[-1][:-step], self.rows[-1][step:]))

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """-1 for empty ranges."""
        out, size = np.full(len(low), -1), high - low
        for k, row in enumerate(self.rows):
            own = np.flatnonzero((size >> k) == 1)
            out[own] = np.maximum(row[low[own]], row[high[own] - (1 << k)])
        return out


class _Sorted:
    def __init__(self, values: np.ndarray, rank: np.ndarray):
        order = np.lexsort((rank, values))
        self.v, self.rank = values[order], rank[order]
        self.n = len(values)
        self.maxima = _Maxima(self.rank) if self.n else None

    def lowest(self) -> float:
        return float(_rounded(np.diff(self.v)).min())

    def ranges(self, level: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places of the partners of each number at a rounded difference: above it, and below it."""
        at, end, none = np.arange(self.n), np.full(self.n, self.n), np.zeros(self.n, np.int64)
        away = lambda j: _rounded(self.v[j] - self.v)
        above = _first(at + 1, end, lambda j: away(j) >= level), _first(at + 1, end, lambda j: away(j) > level)
        below = _first(none, at, lambda j: away(j) <= level), _first(none, at, lambda j: away(j) < level)
        return [above, below]

    def pairs(self, level: float) -> Iterator[tuple[int, int]]:
        """Places of the pairs at a rounded difference, by names."""
        ranges = self.ranges(level)
        best = np.maximum(*(self.maxima.of(a, b) for a, b in ranges))
        own = np.flatnonzero(best > self.rank)
        for x in own[np.argsort(self.rank[own])]:
            partners = np.concatenate([np.arange(a[x], b[x]) for a, b in ranges])
            partners = partners[self.rank[partners] > self.rank[x]]
            for y in partners[np.argsort(self.rank[partners])]:
                yield int(x), int(y)

    def above(self, level: float) -> float | None:
        """The next larger rounded difference there is."""
        after = self.ranges(level)[0][1]
        own = np.flatnonzero(after < self.n)
        return float(_rounded(self.v[after[own]] - self.v[own]).min()) if len(own) else None


def closest(values: np.ndarray, rank: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The first n pairs, as ranks of their names."""
    s, out = _Sorted(values, rank), []
    level = s.lowest() if s.n > 1 else None
    while level is not None:
        for x, y in s.pairs(level):
            if len(out) == n:
                return out
            out.append((int(s.rank[x]), int(s.rank[y])))
        level = s.above(level)
    return out


def matched(values: np.ndarray, rank: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The first n pairs of which none shares a number with one before."""
    out = []
    while len(values) > 1 and len(out) < n:
        s = _Sorted(values, rank)
        x, y = next(s.pairs(s.lowest()))
        out.append((int(s.rank[x]), int(s.rank[y])))
        left = (s.rank != s.rank[x]) & (s.rank != s.rank[y])
        values, rank = s.v[left], s.rank[left]
    return out
