"""Vectorised word handling over the UTF-8 buffers of Arrow text columns.

Words are found and hashed with numpy over whole blocks of documents. Separators are
ASCII bytes only, so byte-level splitting equals splitting by code points. A word is
identified by a 64-bit hash of its bytes; two different words collide with
probability about 5e-20 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = {0x20, *range(0x09, 0x0E)}

#: True for bytes of words between white space.
SPACED = np.array([b not in _SPACE for b in range(256)])
#: True for bytes of alphanumeric words (any byte above ASCII belongs to a word).
ALNUM = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
#: A-Z to a-z, other bytes unchanged.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (grown by doubling)."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(max(n, 1 << 16), base, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits depend on all others."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h = h ^ (h >> U64(27))
    h = h * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.large_string():
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def blocks(table: pa.RecordBatch | pa.Table, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into (first row, end row, offsets, bytes) of about `most` bytes; a longer text is one block."""
    offsets, data = text_buffers(table.column(column))
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
        i = j


class Words:
    """The words of a block of documents: byte spans, and where each document's words begin."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = kind[data]
        n = len(data)
        first, last = inside.copy(), inside.copy()
        if n:
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            edge = offsets[:-1][offsets[:-1] < n]
            first[edge] = inside[edge]
            edge = offsets[1:][offsets[1:] > 0] - 1
            last[edge] = inside[edge]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        #: words of document d are those from at[d] to at[d + 1]
        self.at = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.at)
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A hash of each word, or of its first `most` bytes."""
        if not len(self.starts):
            return np.zeros(0, U64)
        up, down = powers(len(self.data))
        v = _TABLE[self.data]
        v *= up[: len(v)]
        total = np.cumsum(v, dtype=U64)
        s = self.starts
        ends = self.ends if most is None else np.minimum(self.ends, s + most)
        return mix((total[ends - 1] - total[s] + v[s]) * down[s])

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words (runs over document ends included; the caller masks them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    up, _ = powers(64)
    total = words[:m].copy()
    for k in range(1, n):
        total += words[k : k + m] * up[k]
    return mix(total)


def run_hashes(words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of words[first[i]:end[i]] for each i (runs are not empty)."""
    if not len(first):
        return np.zeros(0, U64)
    up, down = powers(len(words))
    v = words * up[: len(words)]
    total = np.cumsum(v, dtype=U64)
    return mix((total[end - 1] - total[first] + v[first]) * down[first] + (end - first).astype(U64))


def window_mask(at: np.ndarray, n_words: int, n: int) -> np.ndarray:
    """True where a run of n words stays in its document."""
    ok = np.zeros(max(n_words - n + 1, 0), bool)
    if len(ok):
        step = np.zeros(len(ok) + 1, np.int64)
        counts = np.diff(at)
        d = counts >= n
        np.add.at(step, at[:-1][d], 1)
        np.add.at(step, at[1:][d] - n + 1, -1)
        ok = np.cumsum(step[:-1]) > 0
    return ok


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + lengths[i]."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """An Arrow list column from flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind or pa.int64()))


def _starts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of a sorted array, where each begins, and the end)."""
    at = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[at], np.append(at, len(x))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (a plain sort, which is faster on hashes than a hash table)."""
    return _starts(np.sort(x))[0]


def by_shard(shard: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """Groups rows by shard: the shards that occur, and a list column for each column (64-bit)."""
    order = np.argsort(shard, kind="stable")
    there, offsets = _starts(shard[order])
    return there, [list_array(c[order].view(np.int64) if c.dtype == U64 else c[order], offsets, pa.float64() if c.dtype == np.float64 else pa.float32() if c.dtype == np.float32 else None) for c in columns]


def flat(column: pa.ChunkedArray | pa.Array, dtype=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, lengths) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    lengths = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False), lengths.astype(np.int64)


def lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of values in a sorted table, and which are there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    i = np.searchsorted(table, values)
    i[i == len(table)] = 0
    return i, table[i] == values


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites i[k] and j[k] in `label` (a smaller index wins)."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(label, high, low)
        while (up := label[label]).tobytes() != label.tobytes():
            label[:] = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (node, smallest node) that connect what the pairs (a, b) connect."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    unite(label, at[: len(a)], at[len(a) :])
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]
