"""Benchmark decontamination with one Aho-Corasick automaton over normalised windows.

Words are runs of letters, digits and non-ASCII characters with A-Z lower-cased. A window is
`length` consecutive words of a benchmark item; a shorter item is one window. Each text is scanned
once: its words become symbols of the benchmark's own vocabulary (any other word breaks a
run), and the automaton runs over the symbol runs. Word positions map back to
character offsets of the original text.

The benchmark is a stated query set. It is cut into groups of at most `most_bytes` of text, items that are longer into
parts that overlap by a window less a word, so that no window is lost and no group has more distinct words than there are symbols.
A group's items are broadcast, and each Python worker builds the one automaton from them and keeps it for its
later tasks. Usually there is one group. A larger benchmark takes a pass for each group, cut by checkpoints, which carries the
hits along: neither the driver nor a task ever holds more than one group.
Null, empty or wordless texts and items hit nothing. Items with equal ids count once; those without an id count as one, which is
a null at the end of the items hit. Repeated documents are judged each, texts of any length whole; ids are whole numbers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .util import cut

LENGTH = 10
MOST_BYTES = 2_000_000  # of text of a group; a word takes two bytes, so this is at most a million distinct words
_FIRST = 0x10000  # code points for symbols, above the surrogates
SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>"
_CARRIED = "struct<items:array<string>,first:array<bigint>,end:array<bigint>>"
_CARRIED_ARROW = pa.struct([("items", pa.list_(pa.string())), ("first", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Windows:
    """Benchmark windows over a vocabulary of word hashes, and the automaton over them."""

    def __init__(self, items: list[tuple[str | None, str]], length: int):
        import ahocorasick

        w = K.Words(*K.text_buffers(pa.array([t for _, t in items], pa.large_string())), K.ALNUM, lower=True)
        self.vocabulary, symbols = np.unique(w.hashes(), return_inverse=True)
        text, windows = self.spell(symbols), {}
        for (name, _), a, b in zip(items, w.at[:-1], w.at[1:], strict=True):
            for i in range(a, max(b - length + 1, a + (b > a))):
                own = windows.setdefault(text[i : min(i + length, b)], [])
                if not own or own[-1] != name:
                    own.append(name)
        self.shortest = min(map(len, windows), default=0)
        self.automaton = ahocorasick.Automaton()
        for window, names in windows.items():
            self.automaton.add_word(window, (len(window), names))
        if windows:
            self.automaton.make_automaton()

    @staticmethod
    def spell(symbols: np.ndarray) -> str:
        return (symbols + _FIRST).astype("<u4").tobytes().decode("utf-32-le")


_built: dict[str, Windows] = {}


def _windows(token: str, items: list[tuple[str | None, str]], length: int) -> Windows:
    """The windows of a group, built once for each worker; those of the group before go."""
    if token not in _built:
        _built.clear()
        _built[token] = Windows(items, length)
    return _built[token]


def scan(windows: Windows, w: K.Words, h: np.ndarray, covered: np.ndarray, found: dict[int, set[str | None]]) -> None:
    """Adds to covered (a difference array over words) and to the items found for each document."""
    symbol, there = K.lookup(windows.vocabulary, h)
    if not there.any():
        return
    first = there.copy()
    first[1:] &= ~there[:-1]
    edge = w.at[:-1][w.at[:-1] < len(h)]
    first[edge] = there[edge]
    last = there.copy()
    last[:-1] &= ~there[1:]
    edge = w.at[1:][w.at[1:] > 0] - 1
    last[edge] = there[edge]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = b - a >= windows.shortest
    a, b = a[long], b[long]
    if not len(a):
        return
    # the runs one after another, each followed by a symbol that no window holds
    at = K.ragged(a, b - a + 1)
    ends = np.cumsum(b - a + 1) - 1
    codes = symbol[np.minimum(at, len(symbol) - 1)]
    codes[ends] = -1
    for end, (size, names) in windows.automaton.iter(windows.spell(codes)):
        last_word = int(at[end])
        covered[last_word - size + 1] += 1
        covered[last_word + 1] -= 1
        found.setdefault(int(np.searchsorted(w.at, last_word, "right")) - 1, set()).update(names)


def _parts(text: str, length: int, most_bytes: int) -> Iterator[str]:
    """The text, or parts of it that hold each run of `length` words."""
    if len(text) * 4 <= most_bytes or len(raw := text.encode()) <= most_bytes:
        yield text
        return
    w = K.Words(np.array([0, len(raw)]), np.frombuffer(raw, np.uint8), K.ALNUM)
    first = 0
    while first < len(w):
        end = max(first + length, int(np.searchsorted(w.ends, w.starts[first] + most_bytes, "right")))
        yield raw[w.starts[first] : w.ends[min(end, len(w)) - 1]].decode()
        first = end - length + 1 if end < len(w) else end


def _groups(benchmark: DataFrame, id_col: str, text_col: str, length: int, most_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    items = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null")
    group, room = [], most_bytes
    for r in items.toLocalIterator():
        for part in _parts(r.t, length, most_bytes):
            size = len(part.encode()) + 1
            if size > room and group:
                yield group
                group, room = [], most_bytes
            group.append((r.i, part))
            room -= size
    yield group


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", length: int = LENGTH, most_bytes: int = MOST_BYTES, keep: bool = False) -> DataFrame:
    """One row per document: words, hit words, items hit, and hit spans as code points of the original.

    keep: with all columns of docs (under their names; new columns of the same name come out once, new).
    """
    names = ["n_words", "n_hit", "items", "spans"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col, "doc_id", "text", *names)] if keep else []))
    before = None
    for group in _groups(benchmark, item_col, item_text, length, most_bytes):
        if before is not None:
            rows = cut(_passed(rows, before, length, False, True))
        before = group
    return _passed(rows, before, length, True, keep)


def _passed(rows: DataFrame, items: list[tuple[str | None, str]], length: int, last: bool, keep: bool) -> DataFrame:
    """One pass over the texts with one group; it adds to the hits of earlier passes, which travel in a column of their own."""
    carried = "_hits_so_far"
    while carried in rows.columns and dict(rows.dtypes)[carried] != _CARRIED:
        carried += "_"
    has = carried in rows.columns
    kept = [c for c in rows.columns if c != carried] if keep else ["doc_id"]
    shared, token = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _windows(token, shared.value, length)
        for batch in batches:
            for i, j, offsets, data in K.blocks(batch):
                w = K.Words(offsets, data, K.ALNUM, lower=True)
                h = w.hashes()
                covered, found = np.zeros(len(h) + 1, np.int64), {}
                if has:
                    for d, old in enumerate(batch.column(carried)[i:j].to_pylist()):
                        if old["items"]:
                            found[d] = set(old["items"])
                            np.add.at(covered, w.at[d] + np.array(old["first"], np.int64), 1)
                            np.add.at(covered, w.at[d] + np.array(old["end"], np.int64), -1)
                if windows.shortest:
                    scan(windows, w, h, covered, found)
                hit = np.cumsum(covered)[:-1] > 0
                own = [batch.column(c)[i:j] for c in kept]
                names_of = {d: sorted(hits - {None}) + [None] * (None in hits) for d, hits in found.items()}
                if not last:
                    runs = {d: _hit_runs(w, hit, d) for d in found}
                    told = [{"items": names_of[d], "first": (runs[d][0] - w.at[d]).tolist(), "end": (runs[d][1] - w.at[d] + 1).tolist()} if d in found else {"items": [], "first": [], "end": []} for d in range(j - i)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(told, _CARRIED_ARROW)], names=[*kept, carried])
                    continue
                total = np.concatenate([[0], np.cumsum(hit)])
                spans = [_original(w, hit, d, data) if d in found else [] for d in range(j - i)]
                items_of = [names_of.get(d, []) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.array(w.counts.astype(np.int64)), pa.array(total[w.at[1:]] - total[w.at[:-1]]), pa.array(items_of, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    names=[*kept, "n_words", "n_hit", "items", "spans"],
                )

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", " + (SCHEMA if last else f"`{carried}` {_CARRIED}"))


def _hit_runs(w: K.Words, hit: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) word of each run of hit words of document d."""
    own = np.flatnonzero(hit[w.at[d] : w.at[d + 1]]) + w.at[d]
    gap = np.flatnonzero(np.diff(own) > 1)
    return own[np.concatenate([[0], gap + 1])], own[np.concatenate([gap, [len(own) - 1]])]


def _original(w: K.Words, hit: np.ndarray, d: int, data: np.ndarray) -> list[dict[str, int]]:
    """Runs of hit words of document d as code point spans of its text."""
    first, last = _hit_runs(w, hit, d)
    at = w.offsets[d]
    points = np.concatenate([[0], np.cumsum((data[at : w.offsets[d + 1]] & 0xC0) != 0x80)])
    return [{"start": int(points[s - at]), "end": int(points[e - at])} for s, e in zip(w.starts[first], w.ends[last], strict=True)]
