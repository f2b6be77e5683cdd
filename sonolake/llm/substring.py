"""Substring de-duplication with sharded FM-indexes.

Every window of `length` words of a document is judged against all other documents; words
covered by a window that also starts in a document with a smaller id go.

Windows are dealt to shards by content: the smallest hash among a window's inner runs of
`anchor` words (its minimiser) is the same wherever the window occurs, so equal windows
always meet in one shard and no shard ever looks at another's text.

1. By bucket of documents: the distinct minimisers with the smallest and largest id there.
2. By shard of minimisers: those that occur in more than one document go back to the
   buckets that sent them. Windows under other minimisers occur in one document only.
   A minimiser of more than `hot` runs, summed over the buckets, is marked.
3. By bucket: runs of windows under such a minimiser, each distinct run once with its
   smallest id, go to the shards as token arrays. Under a marked minimiser each window is
   a run of its own and is dealt by its own hash: equal windows still meet, and a sentence
   that stands in many documents between different words is spread over all shards.
4. By shard: an FM-index over the runs; the runs are streamed through it by backward search,
   which gives for each window the smallest id among its occurrences. Intervals that
   reach another document go back to the buckets.
5. By bucket: words covered by reported intervals go.

A minimiser, run or window sends at most one entry for each bucket, however many copies
there are. Buckets are dealt by id and text and hold about as many bytes of
text, shards about as many runs, at every size; their number grows with the input.
Null text has no words. A null id counts as the largest. Rows with equal ids are
one document for the comparison. A text longer than a bucket has a bucket of its own size. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .fmindex import FMIndex
from .util import parts, text_size

LENGTH, ANCHOR = 13, 5
BUCKET_BYTES, SHARD_BYTES = 4 << 20, 6 << 20
HOT_RUNS = 20_000  # distinct runs of one minimiser, summed over buckets, beyond which its windows are dealt one by one
_LONGEST = 64  # windows of a run
_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_LARGEST = np.iinfo(np.int64).max


def _runs(words: K.Words, h: np.ndarray, length: int, anchor: int):
    """Runs of windows with one minimiser: (first window, windows, minimiser, document)."""
    ok = K.window_mask(words.at, len(h), length)
    if not ok.any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    g = K.gram_hashes(h, anchor)
    span, have, least = length - anchor + 1, 1, g
    while have < span:  # sliding minimum by doubling
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    at = np.flatnonzero(ok)
    key = least[at]
    doc = np.searchsorted(words.at, at, "right") - 1
    fresh = np.ones(len(at), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, len(at)))
    if size.max() > _LONGEST:
        pieces = -(-size // _LONGEST)
        inner = K.ragged(np.zeros(len(pieces), np.int64), pieces) * _LONGEST
        start, whole = np.repeat(start, pieces) + inner, np.repeat(size, pieces)
        size = np.minimum(_LONGEST, whole - inner)
    return at[start], size, key[start], doc[start]


def _parsed(t: pa.Table, length: int, anchor: int):
    ids = t.column("_id").to_numpy().astype(np.int64)
    for i, _, offsets, data in K.blocks(t):
        w = K.Words(offsets, data)
        h = w.hashes()
        yield i, w, h, _runs(w, h, length, anchor), ids


def _least_by(key: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    order = np.argsort(key)
    key, lo, hi = key[order], lo[order], hi[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), order[at]) if len(key) else (key, lo, hi, order)


def _apart(n: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, first window in it) of what is sent: a run as a whole, or each window of a hot one."""
    pieces = np.where(hot, n, 1)
    return np.repeat(np.arange(len(n)), pieces), K.ragged(np.zeros(len(n), np.int64), pieces)


def _rows(schema: list[str], columns: list) -> pa.Table:
    return pa.table(dict(zip(schema, columns, strict=True)))


def _ends(there: np.ndarray, shard: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Offsets of the lists of the shards `there`, of which shard[i] gets sizes[i] values more."""
    total = np.zeros(len(there) + 1, np.int64)
    np.add.at(total, np.searchsorted(there, shard) + 1, sizes)
    return np.cumsum(total)


def _table(names: list[str], bucket: int, shard: np.ndarray, *columns: np.ndarray) -> pa.Table:
    there, lists = K.by_shard(shard, *columns)
    return _rows(names, [pa.array(np.full(len(there), bucket)), pa.array(there.astype(np.int64)), *lists])


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


_L = pa.list_(pa.int64())
_KEYS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("key", _L), ("lo", _L), ("hi", _L), ("runs", _L)])
_TEXTS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("run", _L), ("size", _L), ("lo", _L), ("hi", _L), ("words", _L)])
_HITS = "bucket long, run array<long>, size array<long>, least array<long>"


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT_RUNS, bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text: see the module."""
    _, size = text_size(docs, text_col)
    n_buckets, n_shards = parts(size, bucket_bytes), parts(size, shard_bytes)
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(n_buckets)).alias("bucket"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(_LARGEST)).alias("_id"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
    )

    def keys_of(t: pa.Table) -> pa.Table:
        bucket, found = t.column("bucket")[0].as_py(), []
        for i, _, h, (first, n, key, doc), ids in _parsed(t, length, anchor):
            d = ids[i + doc]
            run, at = np.unique(K.run_hashes(h, first, first + n + length - 1), return_index=True)
            found.append((*_least_by(key, d, d)[:3], run, key[at]))
        key, lo, hi, run, of = (np.concatenate(x) for x in zip(*found, strict=True))
        key, lo, hi, _ = _least_by(key, lo, hi)
        runs = np.bincount(np.searchsorted(key, of[np.unique(run, return_index=True)[1]]), minlength=len(key))
        return _table(_KEYS.names, bucket, (key % np.uint64(n_shards)).astype(np.int64), key, lo, hi, runs)

    def repeated(t: pa.Table) -> pa.Table:
        key, sizes = K.flat(t.column("key"))
        lo, hi = K.flat(t.column("lo"))[0], K.flat(t.column("hi"))[0]
        bucket = np.repeat(t.column("bucket").to_numpy(), sizes)
        _, back = np.unique(key, return_inverse=True)
        least, most = np.full(back.max(initial=-1) + 1, _LARGEST), np.full(back.max(initial=-1) + 1, np.iinfo(np.int64).min)
        np.minimum.at(least, back, lo)
        np.maximum.at(most, back, hi)
        runs = np.zeros(len(least), np.int64)
        np.add.at(runs, back, K.flat(t.column("runs"))[0])
        often = (least < most)[back]
        there, lists = K.by_shard(bucket[often], key[often])
        marked = often & (runs > hot)[back]
        own = key[marked][np.argsort(bucket[marked], kind="stable")]
        ends = _ends(there, bucket[marked], np.ones(len(own), np.int64))
        return _rows(["bucket", "key", "hot"], [pa.array(there.astype(np.int64)), *lists, K.list_array(own, ends)])

    def runs_of(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t) or not len(told):
            return _empty(_TEXTS)
        known, found, tokens, base = np.sort(K.flat(told.column("key"))[0].view(np.uint64)), [], [], 0
        marked = np.sort(K.flat(told.column("hot"))[0].view(np.uint64))
        for i, _, h, (first, n, key, doc), ids in _parsed(t, length, anchor):
            some = K.lookup(known, key)[1]
            first, n, key, d = first[some], n[some], key[some], ids[i + doc[some]]
            if len(first):
                single = K.lookup(marked, key)[1]
                own, window = _apart(n, single)
                # a size of 0 stands for one window under a marked minimiser
                first, n, key, d = first[own] + window, np.where(single, 0, n)[own], key[own], d[own]
                run, lo, hi, at = _least_by(K.run_hashes(h, first, first + np.maximum(n, 1) + length - 1), d, d)
                found.append((run, lo, hi, key[at], first[at] + base, n[at]))
            tokens.append(h)
            base += len(h)
        if not found:
            return _empty(_TEXTS)
        run, lo, hi, key, first, n = (np.concatenate(x) for x in zip(*found, strict=True))
        run, lo, hi, at = _least_by(run, lo, hi)
        key, first, n, tokens = key[at], first[at], n[at], np.concatenate(tokens)
        shard = (np.where(n == 0, run, key) % np.uint64(n_shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        shard, run, lo, hi, first, n = (x[order] for x in (shard, run, lo, hi, first, n))
        there, lists = K.by_shard(shard, run, n, lo, hi)
        n = np.maximum(n, 1)
        words = tokens[K.ragged(first, n + length - 1)]
        ends = _ends(there, shard, n + length - 1)
        return _rows(_TEXTS.names, [pa.array(np.full(len(there), t.column("bucket")[0].as_py())), pa.array(there.astype(np.int64)), *lists, K.list_array(words.view(np.int64), ends)])

    def matched(t: pa.Table) -> pa.Table:
        run, sizes = K.flat(t.column("run"))
        n, lo, hi = (K.flat(t.column(c))[0] for c in ("size", "lo", "hi"))
        words = K.flat(t.column("words"))[0].view(np.uint64)
        bucket, single, n = np.repeat(t.column("bucket").to_numpy(), sizes), n == 0, np.maximum(n, 1)
        distinct, at, back = np.unique(run, return_index=True, return_inverse=True)
        weight = np.full(len(distinct), _LARGEST)
        np.minimum.at(weight, back, lo)
        ends = np.cumsum(n + length - 1)
        lengths = (n + length - 1)[at]
        windows, least = FMIndex(words[K.ragged((ends - (n + length - 1))[at], lengths)], lengths, length, weight).statistics()
        w_at = np.cumsum(windows) - windows
        smallest = np.minimum.reduceat(least, w_at) if len(least) else least
        told = np.flatnonzero(smallest[back] < hi)
        told = told[np.argsort(bucket[told], kind="stable")]
        there, (runs, counts) = K.by_shard(bucket[told], run[told], np.where(single[told], 0, windows[back[told]]))
        values = least[K.ragged(w_at[back[told]], windows[back[told]])]
        ends = _ends(there, bucket[told], windows[back[told]])
        return _rows(["bucket", "run", "size", "least"], [pa.array(there.astype(np.int64)), runs, counts, K.list_array(values, ends)])

    nothing = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())] + [("kept_text", pa.string())] * with_text).empty_table()

    def cleaned(t: pa.Table, told: pa.Table) -> pa.Table:
        if not len(t):
            return nothing
        hit = len(told) > 0
        if hit:
            run, n = K.flat(told.column("run"))[0].view(np.uint64), K.flat(told.column("size"))[0]
            order = np.argsort(run)
            least, w_at = K.flat(told.column("least"))[0], (np.cumsum(np.maximum(n, 1)) - np.maximum(n, 1))[order]
            run, single = run[order], n[order] == 0
            alone, alone_at, run, w_at = run[single], w_at[single], run[~single], w_at[~single]
        counts, removed, digests, kept_texts = [], [], [], []
        for i, w, h, (first, size, _, doc), ids in _parsed(t, length, anchor):
            gone = np.zeros(len(h) + 1, np.int64)
            if hit and len(first) and len(alone):
                window, d = K.ragged(first, size), np.repeat(ids[i + doc], size)
                at, there = K.lookup(alone, K.run_hashes(h, window, window + length))
                earlier = window[there][least[alone_at[at[there]]] < d[there]]
                np.add.at(gone, earlier, 1)
                np.add.at(gone, earlier + length, -1)
            if hit and len(first):
                at, there = K.lookup(run, K.run_hashes(h, first, first + size + length - 1))
                first, size, doc, at = first[there], size[there], doc[there], at[there]
                window = K.ragged(first, size)
                earlier = window[least[K.ragged(w_at[at], size)] < np.repeat(ids[i + doc], size)]
                np.add.at(gone, earlier, 1)
                np.add.at(gone, earlier + length, -1)
            keep = np.cumsum(gone)[:-1] == 0
            total = np.concatenate([[0], np.cumsum(~keep)])
            counts.append(w.counts)
            removed.append(total[w.at[1:]] - total[w.at[:-1]])
            raw = w.data.tobytes()
            for d in range(len(w.counts)):
                own = raw[w.offsets[d] : w.offsets[d + 1]].split()
                if removed[-1][d]:
                    own = [x for x, k in zip(own, keep[w.at[d] : w.at[d + 1]].tolist(), strict=True) if k]
                kept = b" ".join(own)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    kept_texts.append(kept.decode())
        columns = [t.column("doc_id"), pa.array(np.concatenate(counts).astype(np.int64)), pa.array(np.concatenate(removed).astype(np.int64)), pa.array(digests, pa.string()), pa.array(kept_texts, pa.string())]
        return _rows(nothing.column_names, columns[: nothing.num_columns])

    a, per_bucket = "array<long>", rows.groupBy("bucket")
    sent = per_bucket.applyInArrow(keys_of, f"bucket long, shard long, key {a}, lo {a}, hi {a}, runs {a}")
    told = sent.groupBy("shard").applyInArrow(repeated, f"bucket long, key {a}, hot {a}")
    texts = per_bucket.cogroup(told.groupBy("bucket")).applyInArrow(runs_of, f"bucket long, shard long, run {a}, size {a}, lo {a}, hi {a}, words {a}")
    hits = texts.groupBy("shard").applyInArrow(matched, _HITS)
    return per_bucket.cogroup(hits.groupBy("bucket")).applyInArrow(cleaned, _RESULT + ", kept_text string" * with_text)
