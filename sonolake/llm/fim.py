"""Fill-in-middle by a parallel scan of a finite automaton over UTF-8 bytes.

The automaton reads the tokens `[A-Za-z]+|[^A-Za-z]` and looks for the three sentinels. A stretch of bytes is summed up by its
transition function: for each state it may be entered in, the state it is left in, the tokens that begin in it and the sentinels
that end in it. Functions compose associatively, so stretches are read side by side and entry states follow from prefix compositions.

1. Texts of at most `chunk` bytes are read where they are: stretches of `WIDTH` bytes side by side, composed within a document.
2. Longer texts are dealt to all tasks in chunks of that size. Each chunk gives its function, the functions of a document are
   composed in order (some 100 bytes for each chunk), and only the one or two chunks that hold a cut are read again to find it.
   A cut that falls on a chunk's edge is the chunk's first byte.

Results, the same for both ways: a null text is the empty one; an empty text, and one that holds a sentinel, stays plain. A null
doc_id is hashed as no digits. Equal rows give equal rows, each of them; an empty table gives none. No column but doc_id and text is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkernel import blocks, ragged
from .util import cut

CHUNK, WIDTH = 1 << 18, 256
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

# Classes of bytes: another one, a letter, P S or M, <, >, a byte within a code point, none (behind the end of a stretch).
_OTHER, _LETTER, _NAME, _OPEN, _CLOSE, _WITHIN, _NONE = range(7)
# States: outside, in letters, behind <, behind < and one of P S M.
_STATES = 4
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
CLASS[[ord(c) for c in "PSM"]] = _NAME
CLASS[ord("<")], CLASS[ord(">")], CLASS[128:192] = _OPEN, _CLOSE, _WITHIN

# Tables over state * 7 + class: the next state * 7, and what is counted: a token that begins, a sentinel that ends (from bit 32).
_NEXT = 7 * np.array([[0, 1, 1, 2, 0, 0, 0], [0, 1, 1, 2, 0, 0, 1], [0, 1, 3, 2, 0, 0, 2], [0, 1, 1, 2, 0, 0, 3]], np.intp).ravel()
_COUNTS = np.array([[1, 1, 1, 1, 1, 0, 0], [1, 0, 0, 1, 1, 0, 0], [1, 1, 1, 1, 1, 0, 0], [1, 0, 0, 1, 1, 0, 0]], np.int64).ravel()
_COUNTS[3 * 7 + _CLOSE] += 1 << 32


class Functions:
    """Transition functions of stretches: for each stretch and entry state the exit state, tokens begun and sentinels ended."""

    def __init__(self, exit: np.ndarray, tokens: np.ndarray, sentinels: np.ndarray):
        self.exit, self.tokens, self.sentinels = exit, tokens, sentinels

    @classmethod
    def of(cls, classes: np.ndarray) -> Functions:
        """Of the columns of a matrix of byte classes. Row by row all columns step at once, from every state; once the states of
        each column have met (after a few bytes as a rule), one of them goes on for all."""
        n = classes.shape[1]
        state, count = np.repeat(np.arange(_STATES) * 7, n).reshape(_STATES, n), np.zeros((_STATES, n), np.int64)
        met = np.zeros((1, n), np.int64)
        for row in classes:
            at = state + row
            if len(state) > 1:
                count += _COUNTS[at]
                state = _NEXT[at]
                if (state == state[0]).all():
                    state = state[:1]
            else:
                met += _COUNTS[at]
                state = _NEXT[at]
        count = (count + met).T
        return cls(np.broadcast_to(state // 7, (_STATES, n)).T.copy(), count & 0xFFFFFFFF, count >> 32)

    def take(self, i) -> Functions:
        return Functions(self.exit[i], self.tokens[i], self.sentinels[i])

    def then(self, after: Functions) -> Functions:
        """This stretch and then the other one."""
        add = lambda own, other: own + np.take_along_axis(other, self.exit, 1)
        return Functions(np.take_along_axis(after.exit, self.exit, 1), add(self.tokens, after.tokens), add(self.sentinels, after.sentinels))

    def prefixes(self, place: np.ndarray) -> Functions:
        """For each stretch, that of everything from its document's start to its end; place: its number in the document."""
        out, step = self.take(slice(None)), 1
        while step <= place.max(initial=0):
            i = np.flatnonzero(place >= step)
            both = out.take(i - step).then(out.take(i))
            out.exit[i], out.tokens[i], out.sentinels[i] = both.exit, both.tokens, both.sentinels
            step *= 2
        return out


class Stretches:
    """A block of documents in stretches of WIDTH bytes, with the functions of each."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        size = np.diff(offsets)
        count = -(-size // WIDTH)
        #: stretches of document d are those from at[d] to at[d + 1]
        self.at = np.concatenate([[0], np.cumsum(count)])
        self.place = ragged(np.zeros(len(count), np.int64), count)
        self.first = np.repeat(offsets[:-1], count) + self.place * WIDTH
        self.size = np.minimum(WIDTH, np.repeat(offsets[1:], count) - self.first)
        self.classes = CLASS[data]
        self.functions = Functions.of(self.matrix(np.arange(len(self.first))))
        self.upto = self.functions.prefixes(self.place)

    def matrix(self, stretches: np.ndarray) -> np.ndarray:
        """Byte classes, a column for each stretch."""
        row = np.arange(WIDTH)[:, None]
        there = row < self.size[stretches]
        return np.where(there, self.classes[np.where(there, self.first[stretches] + row, 0)], _NONE) if len(self.classes) else np.full((WIDTH, 0), _NONE)

    def entered(self, stretches: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, tokens begun before) of each stretch, its document being entered in `start`."""
        inner = self.place[stretches] > 0
        before = np.where(inner, stretches - 1, stretches)
        return np.where(inner, self.upto.exit[before, start], start), np.where(inner, self.upto.tokens[before, start], 0)

    def locate(self, docs: np.ndarray, token: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Byte where the given token of each document begins, from the document's start; its end if it has no such token."""
        end = np.zeros(len(docs), np.int64)
        own = np.flatnonzero(self.at[docs + 1] > self.at[docs])
        docs, token, start = docs[own], token[own], start[own]
        low, high = self.at[docs], self.at[docs + 1] - 1  # the first stretch with more than `token` tokens begun up to its end
        while (open_ := low < high).any():
            middle = (low + high) // 2
            enough = self.upto.tokens[middle, start] > token
            low, high = np.where(open_ & ~enough, middle + 1, low), np.where(open_ & enough, middle, high)
        state, begun = self.entered(low, start)
        found = np.full(len(low), -1)
        state = state * 7
        for k, row in enumerate(self.matrix(low)):
            step = state + row
            begun = begun + (_COUNTS[step] & 1)
            found[(found < 0) & (begun > token)] = k
            state = _NEXT[step]
        end[own] = np.where(found < 0, self.size[low], found) + self.place[low] * WIDTH
        return end


def _points(offsets: np.ndarray, data: np.ndarray, docs: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of documents up to a byte."""
    total = np.concatenate([[0], np.cumsum(CLASS[data] != _WITHIN)])
    return total[offsets[docs] + ends] - total[offsets[docs]]


def _cuts(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b = h1 % (n + 1), h2 % (n + 1)
    return np.minimum(a, b), np.maximum(a, b)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds n, sentinels, first and second (code points before the cuts) to whole texts."""
    for batch in batches:
        for i, j, offsets, data in blocks(batch):
            s = Stretches(offsets, data)
            docs = np.arange(j - i)
            none = np.zeros(len(docs), np.int64)
            last = np.where(s.at[1:] > s.at[:-1], s.at[1:] - 1, -1)
            n, held = ((np.where(last >= 0, f[last, 0], 0) if len(f) else none) for f in (s.upto.tokens, s.upto.sentinels))
            part = batch.slice(i, j - i)
            where = [_points(offsets, data, docs, s.locate(docs, c, none)) for c in _cuts(part.column("h1").to_numpy(), part.column("h2").to_numpy(), n)]
            kept = ("doc_id", "text", "h3", "h4")
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in (n, held, *where))], names=[*kept, "n", "sentinels", "first", "second"])


def _binary(part: pa.RecordBatch, i: int) -> np.ndarray:
    return np.frombuffer(part.column("part")[i].as_buffer(), np.uint8)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, k, and the transition function and code points of each chunk."""
    for batch in batches:
        rows = []
        for i in range(len(batch)):
            data = _binary(batch, i)
            s = Stretches(np.array([0, len(data)]), data)
            rows.append((s.upto.exit[-1].tolist(), s.upto.tokens[-1].tolist(), s.upto.sentinels[-1].tolist(), int((CLASS[data] != _WITHIN).sum())))
        kinds = [pa.list_(pa.int64())] * 3 + [pa.int64()]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["key", "k", "exit", "tokens", "sentinels", "points"])


def _resolve(table: pa.Table) -> pa.Table:
    """The chunks of one document composed in order: n, sentinels, and for each cut its chunk, entry state, token and code points before."""
    table = table.sort_by("k")
    grid = lambda c: np.array(table.column(c).to_pylist(), np.int64)
    f = Functions(grid("exit"), grid("tokens"), grid("sentinels"))
    upto = f.prefixes(np.arange(len(table)))
    n = upto.tokens[-1:, 0]
    points = np.cumsum(table.column("points").to_numpy())
    rows = {"key": [], "n": [], "sentinels": [], "cut": [], "k": [], "state": [], "token": [], "before": []}
    for name, token in enumerate(_cuts(grid("h1")[:1], grid("h2")[:1], n)):
        k = min(int(np.searchsorted(upto.tokens[:, 0], token[0], "right")), len(table) - 1)
        values = (table.column("key")[0].as_py(), n[0], upto.sentinels[-1, 0], name, k, upto.exit[k - 1, 0] if k else 0, token[0] - (upto.tokens[k - 1, 0] if k else 0), points[k - 1] if k else 0)
        for column, value in zip(rows.values(), values, strict=True):
            column.append(value if isinstance(value, str) else int(value))
    return pa.table(rows)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points before each cut, from the chunk that holds it."""
    for batch in batches:
        found = []
        for i in range(len(batch)):
            data, one = _binary(batch, i), np.zeros(1, np.int64)
            offsets = np.array([0, len(data)])
            end = Stretches(offsets, data).locate(one, one + batch.column("token")[i].as_py(), one + batch.column("state")[i].as_py())
            found.append(int(_points(offsets, data, one, end)[0]) + batch.column("before")[i].as_py())
        kept = ("key", "n", "sentinels", "cut")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.int64())], names=[*kept, "at"])


def _long(texts: DataFrame, chunk: int) -> DataFrame:
    """What _scan gives, for texts of more than one chunk."""
    name = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "text"), 256)
    whole = cut(texts.withColumn("key", name))
    one = whole.dropDuplicates(["key"])  # equal rows have equal cuts
    piece = lambda k: F.substr(F.col("text").cast("binary"), (k * chunk + 1).cast("int"), F.lit(chunk))
    k = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int")))
    parts = one.select("key", "text", k.alias("k")).select("key", "k", piece(F.col("k")).alias("part")).repartition("key", "k")
    functions = parts.mapInArrow(_summarise, "key string, k int, exit array<long>, tokens array<long>, sentinels array<long>, points long")
    chosen = functions.join(one.select("key", "h1", "h2"), "key").groupBy("key").applyInArrow(_resolve, "key string, n long, sentinels long, cut long, k long, state long, token long, before long")
    held = one.select("key", "text").join(chosen, "key").select("key", "n", "sentinels", "cut", "state", "token", "before", piece(F.col("k")).alias("part"))
    at = held.mapInArrow(_find, "key string, n long, sentinels long, cut long, at long").groupBy("key", "n", "sentinels").agg(F.min("at").alias("first"), F.max("at").alias("second"))
    return whole.join(at, "key").select("doc_id", "text", "h3", "h4", "n", "sentinels", "first", "second")


def cut_texts(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, text, h3, h4, n (tokens), sentinels (held in the text), first and second (code points before the two cuts)."""
    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}")
    texts = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", *(h(i) for i in range(4)))
    schema = "doc_id long, text string, h3 long, h4 long, n long, sentinels long, first long, second long"
    return texts.where(F.octet_length("text") <= chunk).mapInArrow(_scan, schema).unionByName(_long(texts.where(F.octet_length("text") > chunk), chunk))


def fill_in_middle(docs: DataFrame, chunk: int = CHUNK, plain_share: int = 10, spm_share: int = 20) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars and middle_chars (null if plain), text, output. Shares in percent: of texts
    left plain, and of the others in the order suffix, prefix, middle."""
    plain = (F.col("text") == "") | (F.col("sentinels") > 0) | (F.col("h3") % 100 >= 100 - plain_share)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_share, "spm").otherwise("psm")
    prefix, middle = F.substr("text", F.lit(1), F.col("first").cast("int")), F.substr("text", (F.col("first") + 1).cast("int"), (F.col("second") - F.col("first")).cast("int"))
    suffix = F.substr("text", (F.col("second") + 1).cast("int"))
    output = F.when(F.col("form") == "plain", F.col("text"))
    output = output.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    inside = lambda c: F.when(F.col("form") != "plain", c)
    return cut_texts(docs, chunk).withColumn("form", form).select("doc_id", "n", "form", inside(F.col("first")).alias("prefix_chars"), inside(F.col("second") - F.col("first")).alias("middle_chars"), "text", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of: its sentinels are the only ones there."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
