"""Language-model scores: a word unigram base, and prediction by partial matching over bytes.

Texts are read as lower-cased (A-Z) words joined by one blank, with an end symbol.

1. Counting covers every word and every run of ORDER + 1 bytes of all training texts, and names the runs of the held-out
   ones. Each task pre-aggregates, and shards by the hash of the whole key add up, so no shard is hot.
2. Runs go to model shards by the last two bytes of their context: a shard has all children of each of its contexts and
   of their suffixes of two bytes or more. Pairs of bytes with more than half a shard's runs go by three bytes instead.
   Runs of one and two bytes (65,792 at most, whatever the input) are broadcast, and those of three bytes that end such a hot
   pair's context, at most 256 for each of them.
3. A shard's byte-context trie gives log probabilities. An escape takes DISCOUNT from every symbol seen. Since the children of
   a context are children of its suffix as well, what symbol exclusion removes at a suffix depends on the next longer context
   only, so normalisers after exclusion are stored with each context, and a run costs a few array look-ups. Every distinct run is
   worked out once, and the answers are dealt by the hash of the run: a table that no frequent context makes uneven.
4. Each bucket of documents asks for its distinct runs and words. A shard of answers meets a number of buckets at a time
   that grows with the number of shards, so what one task reads is bounded, and answers are read again in
   proportion to the input.
5. Buckets add the answers up.

Nothing is left out of the model at any size: it grows with the input, and so does the number of its shards.

Null text is empty: it scores the end symbol alone. A null id is a training row. Repeated rows are scored and counted each.
Texts of any length are scored whole; a longer one than a bucket has a bucket of its own size. An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .util import cut, held_out, parts, text_size

ORDER = 5
DISCOUNT = 0.3  # what a seen symbol's count gives to the escape
SHARD_BYTES = 32 << 20  # of text, whose runs and words one task adds up
RUNS = 400_000  # distinct runs of a shard of the model and of the answers
BUCKET_BYTES = 16 << 20
ASKED = 2  # buckets that one task answers, for each shard of answers
_FLUSH = 3_000_000
_END_WORD = np.uint64(1)
_WORDS, _RUNS = 0, 1
_U64 = np.uint64


def byte_runs(w: K.Words, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs of order + 1 bytes ending at each symbol, first symbol of each document)."""
    lengths = w.ends - w.starts
    docs = len(w.counts)
    sizes = np.zeros(docs + 1, np.int64)
    total = np.concatenate([[0], np.cumsum(lengths + 1)])
    np.maximum(total[w.at[1:]] - total[w.at[:-1]], 1, out=sizes[1:])  # symbols of a document
    symbols_at = np.cumsum(sizes)
    base = symbols_at[:-1] + order * np.arange(1, docs + 1)  # place of each document's first symbol
    line = np.zeros(symbols_at[-1] + order * docs, np.uint8)
    where = total[:-1] - np.repeat(total[w.at[:-1]], w.counts) + np.repeat(base, w.counts)
    line[K.ragged(where, lengths)] = w.data[K.ragged(w.starts, lengths)]
    line[where + lengths] = 32
    line[base + sizes[1:] - 1] = 0
    key = np.zeros(len(line), _U64)
    wide = line.astype(_U64)
    for j in range(order + 1):
        key[j:] |= wide[: len(wide) - j] << _U64(8 * j)
    return key[K.ragged(base, sizes[1:])], symbols_at[:-1]


def _counted(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        key = np.sort(key)
    else:
        order = np.argsort(key)
        key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    if n is None:
        return key[at], np.diff(np.append(at, len(key)))
    return key[at], np.add.reduceat(n, at) if len(at) else n


class _Counter:
    def __init__(self):
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, key: np.ndarray, times: int) -> None:
        key, n = _counted(key)
        self.found.append((key, n * times))
        self.size += len(self.found[-1][0])

    def settled(self, most: int) -> bool:
        """Whether what is held stays under `most` after adding up."""
        if self.size > most and len(self.found) > 1:
            self.found = [_counted(*(np.concatenate(x) for x in zip(*self.found, strict=True)))]
            self.size = len(self.found[0][0])
        return self.size <= most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = _counted(*(np.concatenate(x) for x in zip(*self.found, strict=True))) if self.found else (np.zeros(0, _U64), np.zeros(0, np.int64))
        self.__init__()
        return out


def _shard_of(key: np.ndarray, n: int) -> np.ndarray:
    return (K.mix(key) % _U64(n)).astype(np.int64)


def _pair(key: np.ndarray) -> np.ndarray:
    """The last two bytes of a run's context."""
    return ((key >> _U64(8)) & _U64(0xFFFF)).astype(np.int64)


def _model_shard(key: np.ndarray, hot: np.ndarray, n: int) -> np.ndarray:
    """By the last two bytes of the context, or three where the two are hot."""
    context = key >> _U64(8)
    return _shard_of(np.where(hot[_pair(key)], context & _U64(0xFFFFFF) | _U64(1 << 32), context & _U64(0xFFFF)), n)


def count(docs: DataFrame, order: int, n_shards: int) -> DataFrame:
    """kind, shard, key array, n array: words of the training rows, and runs of all rows (0 for those of held-out rows alone)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {_WORDS: _Counter(), _RUNS: _Counter()}

        def flush(kind: int) -> pa.RecordBatch:
            key, n = counters[kind].take()
            there, lists = K.by_shard(_shard_of(key, n_shards), key, n)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(there), kind)), pa.array(there.astype(np.int64)), *lists], names=["kind", "shard", "key", "n"])

        for batch in batches:
            held = batch.column("held_out")
            for learnt, part in ((1, batch.filter(pc.invert(held))), (0, batch.filter(held))):
                for _, _, offsets, data in K.blocks(part):
                    w = K.Words(offsets, data, lower=True)
                    if learnt:
                        counters[_WORDS].add(np.concatenate([w.hashes(), np.full(len(w.counts), _END_WORD)]), 1)
                    counters[_RUNS].add(byte_runs(w, order)[0], learnt)
                    for kind in counters:
                        if not counters[kind].settled(_FLUSH):
                            yield flush(kind)
        for kind in counters:
            yield flush(kind)

    def add_up(t: pa.Table) -> pa.Table:
        key, n = _counted(K.flat(t.column("key"))[0].view(_U64), K.flat(t.column("n"))[0])
        at = [0, len(key)]
        return pa.table({"kind": t.column("kind")[:1], "shard": t.column("shard")[:1], "key": K.list_array(key.view(np.int64), np.array(at)), "n": K.list_array(n, np.array(at))})

    a = "array<long>"
    sent = docs.select("text", "held_out").mapInArrow(tally, f"kind long, shard long, key {a}, n {a}")
    return cut(sent.groupBy("kind", "shard").applyInArrow(add_up, f"kind long, shard long, key {a}, n {a}"))


def hot_pairs(runs: DataFrame, most: int) -> tuple[int, np.ndarray]:
    """(distinct runs, whether each pair of context bytes has more than `most` of them), from 65,536 counts at most."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            total += np.bincount(_pair(K.flat(b.column("key"))[0].view(_U64)), minlength=1 << 16)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["pair", "n"])

    t = runs.select("key").mapInArrow(tally, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << 16, np.int64)
    total[t.column("pair").to_numpy()] = t.column("n").to_numpy()
    return int(total.sum()), total > most


def short_runs(runs: DataFrame, hot: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(length, keys, counts)] of the runs of one and two bytes, and of three whose context is a hot pair."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = K.flat(b.column("key"))[0].view(_U64), K.flat(b.column("n"))[0]
            for length, some in ((2, n > 0), (3, (n > 0) & hot[_pair(key)])):
                k, c = _counted(key[some] & _mask(length), n[some])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), length)), pa.array(k.view(np.int64)), pa.array(c)], names=["length", "key", "n"])

    t = runs.select("key", "n").mapInArrow(tally, "length long, key long, n long").groupBy("length", "key").agg(F.sum("n").alias("n")).toArrow()
    length, key, n = t.column("length").to_numpy(), t.column("key").to_numpy().view(_U64), t.column("n").to_numpy()
    two, three = (_counted(key[length == k], n[length == k]) for k in (2, 3))
    return [(1, *_counted(two[0] & _U64(0xFF), two[1])), (2, *two), (3, *three)]


class Trie:
    """The byte-context trie as arrays behind one open-addressing hash table."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray]], order: int):
        self.order = order
        keys, counts, tags = [np.zeros(1, _U64)], [np.zeros(1)], [np.zeros(1, np.int64)]  # node 0: the empty context
        for length, key, n in levels:
            contexts = np.unique(key >> _U64(8)) if length > 1 else key[:0]
            for a, k, c in ((length, key, n), (length - 1, contexts, np.zeros(len(contexts)))):
                keys.append(k)
                counts.append(c)
                tags.append(np.full(len(k), a))
        full = np.concatenate(keys) | (np.concatenate(tags).astype(_U64) << _U64(56))
        full, at = np.unique(full, return_inverse=True)
        count_of = np.zeros(len(full))
        np.maximum.at(count_of, at, np.concatenate(counts).astype(float))
        self.full, n = full, len(full)
        self._build()
        length, key = (full >> _U64(56)).astype(np.int64), full & _U64((1 << 56) - 1)
        symbol = np.flatnonzero((count_of > 0) & (length > 0))
        parent = self.find(length[symbol] - 1, key[symbol] >> _U64(8))
        below = np.bincount(parent, count_of[symbol], n)
        kinds = np.bincount(parent, minlength=n).astype(float)
        has = kinds > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            self.log_n = np.log10(count_of - DISCOUNT)
            self.norm = np.where(has, np.log10(below), np.nan)  # nan: no such context
            self.escape = np.log10(DISCOUNT * kinds) - self.norm
            self.direct = np.full(n, np.nan)
            self.direct[symbol] = self.log_n[symbol] - self.norm[parent]
            # after exclusion of a context's children, at its suffix
            suffix = np.zeros(n, np.int64)
            deep = np.flatnonzero(length > 0)
            suffix[deep] = self.find(length[deep] - 1, key[deep] & _mask(length[deep] - 1))
            twin = self.find(length[symbol] - 1, key[symbol] & _mask(length[symbol] - 1))
            twin_n = np.where(twin >= 0, count_of[twin], 0.0)
            away = np.bincount(parent, twin_n, n)
            suffix_ok = (suffix >= 0) & (length > 0)
            rest, rest_kinds = np.maximum(below[suffix] - away, 0), np.maximum(kinds[suffix] - kinds, 0)
            self.next_norm = np.where(suffix_ok & (rest_kinds > 0), np.log10(rest), np.nan)
            self.next_escape = np.where(suffix_ok & (rest_kinds > 0), np.log10(DISCOUNT * rest_kinds) - self.next_norm, 0.0)
        self.last = -np.log10(max(1.0, 256.0 - kinds[0])) if n else -np.log10(256.0)
        for name in ("log_n", "norm", "escape", "direct", "next_norm", "next_escape"):
            setattr(self, name, getattr(self, name).astype(np.float32))

    def _build(self) -> None:
        size = 1 << max(4, int(2 * len(self.full)).bit_length())
        self.shift, self.mask = _U64(64 - size.bit_length() + 1), size - 1
        self.slot_key, self.slot = np.full(size, ~_U64(0)), np.full(size, -1, np.int32)
        left, at = np.arange(len(self.full)), self._home(self.full)
        while len(left):
            free = self.slot[at] < 0
            put, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.slot[put], self.slot_key[put] = who, self.full[who]
            rest = self.slot_key[at] != self.full[left]
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _home(self, full: np.ndarray) -> np.ndarray:
        return ((full * _U64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, length, key: np.ndarray) -> np.ndarray:
        """Nodes of runs of `length` bytes; -1 where there is none."""
        full = key | (np.asarray(length).astype(_U64) << _U64(56))
        at = self._home(full)
        got = self.slot_key[at]
        out = np.where(got == full, self.slot[at], -1)
        open_ = np.flatnonzero((got != full) & (self.slot[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.slot_key[at[open_]]
            hit = got == full[open_]
            out[open_[hit]] = self.slot[at[open_[hit]]]
            open_ = open_[~hit & (self.slot[at[open_]] >= 0)]
        return out

    def logs(self, key: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's last byte after the bytes before it."""
        node = self.find(self.order + 1, key)
        out = np.where(node >= 0, self.direct[node], np.float32(np.nan)).astype(float)
        left = np.flatnonzero(np.isnan(out))
        if not len(left):
            return out
        out[left] = 0
        above = np.full(len(left), -1, np.int64)  # the context escaped from
        for length in range(self.order, -1, -1):
            own = key[left]
            context = self.find(length, (own >> _U64(8)) & _mask(length))
            real = (context >= 0) & ~np.isnan(self.norm[context])
            node = self.find(length + 1, own & _mask(length + 1)).astype(np.int64)
            symbol = (node >= 0) & np.isfinite(self.log_n[node])
            entered = above >= 0
            norm = np.where(entered, self.next_norm[above], self.norm[context])
            hit = real & symbol & ~np.isnan(norm)
            out[left[hit]] += self.log_n[node[hit]] - norm[hit]
            miss = real & ~hit
            out[left[miss]] += np.where(entered, self.next_escape[above], self.escape[context])[miss]
            stay = ~hit
            above = np.where(real, context, above)[stay]
            left = left[stay]
            if not len(left):
                return out
        out[left] += self.last
        return out


def _mask(length):
    return (_U64(1) << (np.asarray(length) * 8).astype(_U64)) - _U64(1)


def _levels(key: np.ndarray, n: np.ndarray, order: int, hot: np.ndarray, short: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """[(length, keys, counts)] of a shard's training runs: the short ones as told, the others from its own (of which some count 0)."""
    pairs = np.unique(_pair(key))
    key, n = key[n > 0], n[n > 0]
    found = [x for x in short if x[0] <= min(order + 1, 2)]
    for length in range(order + 1, 2, -1):
        key, n = _counted(key & _mask(length), n)
        if length > 3:
            found.append((length, key, n))
    if order >= 2:  # three bytes after a hot pair are spread over shards: those counts come from all of them
        own = ~hot[_pair(key)]
        told = np.isin(_pair(short[2][1]), pairs)
        found.append((3, *_counted(np.concatenate([key[own], short[2][1][told]]), np.concatenate([n[own], short[2][2][told]]))))
    return found


def _distinct(found: list[np.ndarray]) -> np.ndarray:
    return K.distinct(np.concatenate(found)) if found else np.zeros(0, _U64)


def _coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values in order, place of each value among them)."""
    order = np.argsort(x)
    s = x[order]
    fresh = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    code = np.empty(len(x), np.int32)
    code[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return s[fresh], code


def _words_of(w: K.Words) -> np.ndarray:
    return np.insert(w.hashes(), w.at[1:], _END_WORD)


def answers(counts: DataFrame, order: int, most: int) -> tuple[DataFrame, int]:
    """(kind, shard, key array, value array of all runs and training words, number of shards).

    The value is log10 of a run's probability, or of a word's count and a half.
    """
    runs = counts.where(F.col("kind") == _RUNS)
    total, hot = hot_pairs(runs, most // 2)
    n = parts(total, most)
    told = counts.sparkSession.sparkContext.broadcast((hot, short_runs(runs, hot)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, c = K.flat(b.column("key"))[0].view(_U64), K.flat(b.column("n"))[0]
            for i in range(0, len(key), _FLUSH):
                there, lists = K.by_shard(_model_shard(key[i : i + _FLUSH], told.value[0], n), key[i : i + _FLUSH], c[i : i + _FLUSH])
                yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), *lists], names=["shard", "key", "n"])

    names = ["kind", "shard", "key", "value"]

    def known(t: pa.Table) -> pa.Table:
        hot, short = told.value
        key, c = _counted(K.flat(t.column("key"))[0].view(_U64), K.flat(t.column("n"))[0])
        trie = Trie(_levels(key, c, order, hot, short), order)
        there, lists = K.by_shard(_shard_of(key, n), key, np.concatenate([np.zeros(0), *(trie.logs(key[i : i + _FLUSH]) for i in range(0, len(key), _FLUSH))]))
        return pa.table(dict(zip(names, [pa.array(np.full(len(there), _RUNS)), pa.array(there.astype(np.int64)), *lists], strict=True)))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, c = K.flat(b.column("key"))[0].view(_U64), K.flat(b.column("n"))[0]
            there, lists = K.by_shard(_shard_of(key, n), key, np.log10(c + 0.5))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(there), _WORDS)), pa.array(there.astype(np.int64)), *lists], names=names)

    a, schema = "array<long>", "kind long, shard long, key array<long>, value array<double>"
    model = runs.select("key", "n").mapInArrow(deal, f"shard long, key {a}, n {a}").groupBy("shard").applyInArrow(known, schema)
    return model.union(counts.where(F.col("kind") == _WORDS).select("key", "n").mapInArrow(words, schema)), n


def lm_score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 5, remainder: int = 1, order: int = ORDER,
    bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, runs: int = RUNS, asked: int = ASKED,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    size = text_size(docs, text_col)[1]
    n_buckets = parts(size, bucket_bytes)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_buckets)).alias("bucket"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col, modulus, remainder).alias("held_out")
    )
    counts = count(rows, order, parts(size, shard_bytes))
    row = counts.where(F.col("kind") == _WORDS).agg(F.sum(F.size("key")).alias("v"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()
    total = int(row.n or 0)
    below = np.log10(total + 0.5 * (int(row.v or 0) + 1))
    told, n_shards = answers(counts, order, runs)
    at_once = asked * n_shards
    unseen = np.log10(0.5)

    def ask(t: pa.Table) -> pa.Table:
        bucket, found = t.column("bucket")[0].as_py(), {_WORDS: [], _RUNS: []}
        for _, _, offsets, data in K.blocks(t):
            w = K.Words(offsets, data, lower=True)
            found[_WORDS].append(K.distinct(_words_of(w)))
            found[_RUNS].append(K.distinct(byte_runs(w, order)[0]))
        out = []
        for kind, each in found.items():
            key = _distinct(each)
            there, (keys,) = K.by_shard(_shard_of(key, n_shards), key)
            out.append(pa.table({"kind": pa.array(np.full(len(there), kind)), "shard": pa.array(there.astype(np.int64)), "piece": pa.array(np.full(len(there), bucket // at_once)), "bucket": pa.array(np.full(len(there), bucket)), "key": keys}))
        return pa.concat_tables(out)

    def answer(asks: pa.Table, told: pa.Table) -> pa.Table:
        names = ["kind", "shard", "bucket", "known", "logs"]
        if not len(asks):
            return pa.table(dict(zip(names, [pa.array([], x) for x in (*[pa.int64()] * 3, pa.list_(pa.float64()), pa.list_(pa.float32()))], strict=True)))
        kind = asks.column("kind")[0].as_py()
        h, sizes = K.flat(asks.column("key"))
        h, ends = h.view(_U64), np.concatenate([[0], np.cumsum(sizes)])
        key, value = (K.flat(told.column("key"))[0].view(_U64), K.flat(told.column("value"), np.float64)[0]) if len(told) else (h[:0], np.zeros(0))
        order_ = np.argsort(key)
        at, there = K.lookup(key[order_], h)
        none = np.zeros(len(ends))
        if kind == _WORDS:
            found = np.full(len(h), unseen)
            found[there] = value[order_[at[there]]]
            lists = [K.list_array(found, ends, pa.float64()), K.list_array(none[:0], none, pa.float32())]
        else:
            if not there.all():
                raise ValueError("a run without an answer")  # every run of every row was counted
            lists = [K.list_array(none[:0], none, pa.float64()), K.list_array(value[order_[at]].astype(np.float32), ends, pa.float32())]
        return pa.table(dict(zip(names, [*(asks.column(c) for c in names[:3]), *lists], strict=True)))

    def finish(own: pa.Table, told: pa.Table) -> pa.Table:
        """Asks went out by shard in ascending order of keys, so the answers of a bucket line up with its keys again."""
        found = []
        for _, _, offsets, data in K.blocks(own):
            w = K.Words(offsets, data, lower=True)
            key, first = byte_runs(w, order)
            runs, words = (_coded(x) for x in (key, _words_of(w)))
            found.append((first, *runs, *words, w.counts + 1))
        kind, shard = told.column("kind").to_numpy(), told.column("shard").to_numpy()
        values = {}
        for k, column, at, dtype in ((_RUNS, "logs", 1, np.float32), (_WORDS, "known", 3, np.float64)):
            key = _distinct([x[at] for x in found])
            mine = np.flatnonzero(kind == k)
            lists = told.column(column).take(pa.array(mine[np.argsort(shard[mine])]))
            value = np.zeros(len(key), dtype)
            value[np.argsort(_shard_of(key, n_shards), kind="stable")] = K.flat(lists, dtype)[0]
            values[k] = key, value
        counts, known, base, scores = [], [], [], []
        for first, runs, run_at, words, word_at, n in found:
            logs = values[_RUNS][1][np.searchsorted(values[_RUNS][0], runs)].astype(np.float64)[run_at]
            word = values[_WORDS][1][np.searchsorted(values[_WORDS][0], words)][word_at]
            at = np.cumsum(n) - n
            counts.append(n)
            known.append(np.add.reduceat((word > unseen).astype(np.int64), at))
            base.append(np.add.reduceat(word, at) - n * below)
            scores.append(np.add.reduceat(logs, first))
        n_tokens, n_known, base, score = (np.concatenate(x) if x else np.zeros(0) for x in (counts, known, base, scores))
        return pa.table({"doc_id": own.column("doc_id"), "held_out": own.column("held_out"), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(n_known.astype(np.int64)),
                         "train_tokens": pa.array(np.full(len(own), total)), "base_score": pa.array(base), "score": pa.array(score)})

    per_bucket, by = rows.groupBy("bucket"), ("kind", "shard", "piece")
    asks = per_bucket.applyInArrow(ask, "kind long, shard long, piece long, bucket long, key array<long>")
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n_buckets - 1) // at_once).cast("long")))
    table = told.select("kind", "shard", pieces.alias("piece"), "key", "value")
    answered = asks.groupBy(*by).cogroup(table.groupBy(*by)).applyInArrow(answer, "kind long, shard long, bucket long, known array<double>, logs array<float>")
    return per_bucket.cogroup(answered.groupBy("bucket")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
