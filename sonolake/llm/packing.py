"""Pattern packing of token pieces into sequences, by non-negative least squares on the length histogram.

1. Each text is tokenised (one pass, no shuffle) and cut into pieces of at most `capacity` ids.
2. The histogram of piece lengths (at most `capacity` numbers, whatever the input) is gathered.
3. On it: patterns of a few lengths that fill a sequence are enumerated, their repeat counts are fitted by
   non-negative least squares and rounded down to what is there, and the rest is packed best-fit,
   longest first, whole runs of equal lengths at a time.
4. Pieces of one length are numbered (hot lengths are split by a salt; the offsets of the salts come from
   counts) and take the slots of their length in order. Sequences are numbered by pattern and repeat.

Null text is empty and gives one piece with the end id alone. Rows of equal ids, and of null ids, are documents of their own that
keep their id; equal rows differ in their places only. A text of any length is cut into pieces, none is dropped. An empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import cut, parts

CAPACITY, END = 4096, 1
_REMEMBERED = 600_000
_MARKS = ".,;:!?#$%&*+-/=@_~()[]{}"
_LATIN = 0x250  # letters below have no parts that normalisation could take off
_PARTS = re.compile(r"[a-z]+|[0-9]|[^a-z0-9]+")


class _Ids(dict):
    """Token ids (little-endian bytes) of a text without spaces, remembered up to a bound.

    Where the tokenizer's own rules say that capitals do not count and that letters, single digits and marks are cut apart, words are
    cut so before they are looked up, and what is not remembered goes to the tokenizer's model, without the steps before it that
    change nothing there. Words with apostrophes, with marks of a special token or with letters outside Latin go the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        steps = lambda part, kind: [rules[part], *rules[part].get(kind, [])] if rules[part] else []
        lowered = any(x.get("type") == "Lowercase" for x in steps("normalizer", "normalizers"))
        before = steps("pre_tokenizer", "pretokenizers")
        cuts = [x["pattern"].get("Regex", "") for x in before if x.get("type") == "Split"]
        levels = any(x.get("type") == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in before)
        self.folds = lowered and levels and any(c.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") for c in cuts)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: small Latin letters as the model sees them
        self.seen = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(chr, range(128, _LATIN)) if c.isalpha()}

    def __missing__(self, word: str) -> bytes:
        small = word.lower()
        if not self.folds or "'" in word or "|" in word or len(small) != len(word):
            ids = self._encoded(word)
        elif word.isascii():
            if small.isalpha():
                ids = self._modelled(small)
            elif len(cut := _PARTS.findall(small)) > 1:
                ids = b"".join(map(self.__getitem__, cut))
            else:
                ids = self._modelled(small) if small.isprintable() else self._encoded(small)
        else:
            body = small.rstrip(_MARKS)
            if not body.isalpha() or ord(max(body)) >= _LATIN:
                ids = self._encoded(word)
            else:
                ids = self._modelled(body.translate(self.seen)) + (self[small[len(body) :]] if len(body) < len(small) else b"")
        if len(self) < _REMEMBERED and len(word) <= 64:  # frequent words come early; later ones are worked out each time
            self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _modelled(self, seen: str) -> bytes:
        """Of small letters alone, or of ASCII marks alone, or of one digit, as the model sees them."""
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()


_loaded: dict[str, _Ids] = {}


def tokenize(texts: list[str | None], path: str) -> Iterator[bytes]:
    """Ids of each text. The vocabulary never joins across a space or line end, so texts are cut there."""
    ids = _loaded.get(path) or _loaded.setdefault(path, _Ids(path))
    get = ids.__getitem__
    for text in texts:
        yield b"".join(map(get, text.replace("\n", " ").split(" "))) if text else b""


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                rows: list[tuple[int | None, int, int, int, int]] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokenize(part.column("text").to_pylist(), tokenizer), strict=True):
                    ids += last
                    for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[s : s + 4 * capacity]
                        rows.append((doc, k, s // 4, len(own) // 4, zlib.crc32(own)))
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: np.ndarray, capacity: int, grid: int = 24) -> list[tuple[int, ...]]:
    """Full sequences of two, three or four of the lengths at hand; the middle lengths come from a grid of quantiles."""
    there = set(lengths.tolist())
    middle = np.unique(lengths[np.linspace(0, len(lengths) - 1, min(grid, len(lengths))).astype(int)]).tolist()
    found = {(capacity,)} if capacity in there else set()
    for a in lengths.tolist():
        if capacity - a in there:
            found.add(tuple(sorted((a, capacity - a), reverse=True)))
        for b in middle:
            if (c := capacity - a - b) in there:
                found.add(tuple(sorted((a, b, c), reverse=True)))
            for d in middle[::4]:
                if (c := capacity - a - b - d) in there:
                    found.add(tuple(sorted((a, b, c, d), reverse=True)))
    return sorted(found, reverse=True)


def fit(found: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradients on the sparse A."""
    if not found:
        return np.zeros(0)
    size = np.array([len(p) for p in found])
    row = np.repeat(np.arange(len(found)), size)
    col = np.concatenate([np.array(p) for p in found])
    times = lambda x: np.bincount(col, x[row], len(counts))
    back = lambda r: np.bincount(row, r[col], len(found))
    v = np.ones(len(found))
    for _ in range(30):  # largest eigenvalue of A'A
        v = back(times(v))
        v /= np.linalg.norm(v)
    step = 1 / (1.05 * np.linalg.norm(back(times(v))))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(times(y) - counts))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / nt * (new - x), nt
    return x


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, repeats) that hold counts[length] pieces of each length."""
    left = counts.astype(np.int64).copy()
    done: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    found = patterns(lengths, capacity)
    x = fit(found, left.astype(float))
    for k in np.argsort(-x, kind="stable"):
        need = defaultdict(int)
        for a in found[k]:
            need[a] += 1
        n = min(int(x[k]), *(int(left[a]) // m for a, m in need.items()))
        if n > 0:
            done.append((found[k], n))
            for a, m in need.items():
                left[a] -= n * m
    # the rest: longest first, into the fullest open pattern that has room; runs of equal lengths together
    room: dict[int, list[list]] = defaultdict(list)
    spaces: list[int] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        space = capacity - sum(lengths)
        if not room[space]:
            bisect.insort(spaces, space)
        room[space].append([lengths, n])

    for a in reversed(np.flatnonzero(left).tolist()):
        n = int(left[a])
        while n:
            at = bisect.bisect_left(spaces, a)
            if at == len(spaces):
                fresh = capacity // a
                if n >= fresh:
                    put((a,) * fresh, n // fresh)
                if n % fresh:
                    put((a,) * (n % fresh), 1)
                break
            space = spaces[at]
            lengths, m = room[space].pop()
            if not room[space]:
                spaces.pop(at)
            fits = min(space // a, -(-n // m))
            use = min(m, n // fits)
            if use < m:
                put(lengths, m - use)
            put(lengths + (a,) * fits, use)
            n -= use * fits
    return done + [(p, n) for space in sorted(room) for p, n in room[space]]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Slots by length: pieces rank .. rank + repeats of a length go to sequences base .. at `offset`."""
    taken: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for lengths, n in planned:
        offset = 0
        for a in lengths:
            rows.append((a, taken[a], base, offset))
            taken[a] += n
            offset += a
        base += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 44) + table[:, 1], "rank": table[:, 1], "base": table[:, 2], "offset": table[:, 3]}


def pack(rows: DataFrame, capacity: int = CAPACITY, salted: int = 2000) -> DataFrame:
    """Adds sequence_id and offset to pieces (any columns besides doc_id, piece, length are kept)."""
    spark = rows.sparkSession
    rows = cut(rows)
    n_salts = parts(rows.count(), salted)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_salts)))
    counted = cut(rows.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    counts = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.length] = r.n
    table = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = counted.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    local = rows.withColumn("k", F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = local.join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k")).drop("salt", "before", "k")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for b in batches:
            rank = b.column("rank").to_numpy().astype(np.int64)
            at = np.searchsorted(t["key"], (b.column("length").to_numpy().astype(np.int64) << 44) + rank, "right") - 1
            keep = [n for n in b.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(t["base"][at] + rank - t["rank"][at]), pa.array(t["offset"][at])], names=[*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {k}" for c, k in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")
