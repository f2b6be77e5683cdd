"""A compressed full-text index over integer sequences: BWT in a wavelet matrix with packed bit vectors.

Suffixes are sorted by their first `depth` symbols (ties by position), which is all that
backward search needs for patterns of at most `depth` symbols.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BitVector:
    """Packed bits with ranks per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(U64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)]).astype(np.int32)
        self.ones = int(self.before[-1])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    def __init__(self, sequence: np.ndarray, symbols: int):
        self.n, self.levels = len(sequence), max(1, int(symbols - 1).bit_length())
        self.bits, self.zeros = [], []
        for k in reversed(range(self.levels)):
            bit = (sequence >> k) & 1
            v = BitVector(bit)
            self.bits.append(v)
            self.zeros.append(self.n - v.ones)
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, *positions: np.ndarray) -> list[np.ndarray]:
        """Occurrences of symbol[j] before each of the positions[.][j]."""
        start = np.zeros(len(symbol), np.int64)
        where = [start, *positions]
        for k, (v, zeros) in enumerate(zip(self.bits, self.zeros, strict=True)):
            one = ((symbol >> (self.levels - 1 - k)) & 1).astype(bool)
            for j, i in enumerate(where):
                r = v.rank(i)
                where[j] = np.where(one, zeros + r, i - r)
        return [i - where[0] for i in where[1:]]


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank of each element among the distinct keys)."""
    order = np.argsort(key, kind="stable")
    new = np.empty(len(key), np.int64)
    s = key[order]
    new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
    return order, new


class FMIndex:
    """Index over pieces (a flat array of 64-bit tokens cut at `lengths`), for statistics up to `depth` tokens.

    What is kept is compressed: the BWT as packed bits of a wavelet matrix, the bounds of runs of suffixes as packed bits,
    the start and the smallest weight of each run, and the streamed text in 32-bit symbols. The suffix array and all
    else that sorting needs goes once the index is built.

    statistics(): streams pieces from right to left, all of them side by side. Each step
    widens the interval of a match of full depth to that of its first depth - 1 tokens
    (the parent in the suffix tree) and extends it backwards by one token with two ranks in the wavelet matrix.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, depth: int, weights: np.ndarray):
        """weights: one for each piece; a run of suffixes keeps the smallest."""
        self.depth = depth
        alphabet = np.unique(tokens)
        pieces = len(lengths)
        n = len(tokens) + pieces
        text = np.ones(n + 1, np.int64)  # 0 ends the text, 1 ends a piece
        text[np.arange(len(tokens)) + np.repeat(np.arange(pieces), lengths)] = np.searchsorted(alphabet, tokens) + 2
        text[n] = 0
        self.text, self.first = text.astype(np.int32), np.cumsum(lengths + 1) - (lengths + 1)
        self.size = size = n + 1
        rank, known = _dense(text)[1], 1
        while known < depth:
            step = min(known, depth - known)
            ahead = np.zeros(size, np.int64)
            ahead[: size - step] = rank[step:] + 1
            order, new = _dense(rank * (size + 1) + ahead)
            half, rank, known = rank, new, known + step
        # runs that share the first depth - 1 tokens: equal in two overlapping halves
        back = depth - 1 - (depth - step)
        a, b = half[order], np.zeros(size, np.int64)
        inside = order + back < size
        b[inside] = half[order[inside] + back] + 1
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        self.parents, self.parent_at = BitVector(fresh), np.append(np.flatnonzero(fresh), size).astype(np.int32)
        deep = rank[order]
        fresh = np.concatenate([[True], deep[1:] != deep[:-1]])
        owner = np.append(np.repeat(weights, lengths + 1), np.iinfo(np.int64).max)
        self.runs, self.least = BitVector(fresh), np.minimum.reduceat(owner[order], np.flatnonzero(fresh))
        symbols = len(alphabet) + 2
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(text[order - 1], symbols)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of symbol + match."""
        below, upto = self.wavelet.rank(symbol, lo, hi)
        return self.smaller[symbol] + below, self.smaller[symbol] + upto

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """For each piece's window of `depth` tokens, the smallest weight of a piece that has it.

        Returns (windows of each piece, flat minima).
        """
        lengths = np.diff(np.append(self.first, self.size - 1)) - 1
        windows = np.maximum(lengths - self.depth + 1, 0)
        out_at = np.cumsum(windows) - windows
        out = np.zeros(int(windows.sum()), np.int64)
        order = np.argsort(-lengths, kind="stable")
        live_until = lengths[order]
        lo, hi = np.zeros(len(order), np.int64), np.full(len(order), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-live_until, -step, "left"))  # pieces longer than step
            p = order[:live]
            position = lengths[p] - 1 - step
            a, b = lo[:live], hi[:live]
            if step >= self.depth:  # matches have full depth: drop the last token
                run = self.parents.rank(a + 1)
                a, b = self.parent_at[run - 1].astype(np.int64), self.parent_at[run].astype(np.int64)
            a, b = self.extend(self.text[self.first[p] + position].astype(np.int64), a, b)
            lo[:live], hi[:live] = a, b
            if step >= self.depth - 1:
                out[out_at[p] + position] = self.least[self.runs.rank(a + 1) - 1]
        return windows, out
