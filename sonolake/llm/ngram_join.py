"""N-gram Jaccard join: every pair of texts whose word n-gram sets reach a similarity, and their groups.

1. Each text becomes its set of n-gram hashes. Equal sets form one class (partial aggregation), and only a
   class's smallest id goes on.
2. Candidates, exactly, by signatures of which similar sets have one in common.
   Thresholds at which a part (below) holds FULL / 2 n-grams or more: sets a and b that reach num/den differ in at most
   (|a| + |b|)(den - num)/(den + num) n-grams.
   The hash space is cut into SPARE + 1 parts more than that, so a similar pair agrees on at least SPARE + 1 whole
   parts. Each set sends one signature for each part, but leaves out parts of at most THIN n-grams if it has no more
   than SPARE of them: of a pair's common parts one is then left, unless both sets have more thin parts, and
   then both send all. How many parts there are follows from a set's size class, and sets send those of
   every class up to their largest partner's as well.
   Lower thresholds, whose parts would be single n-grams: the n-grams that come first in one global order, as many as
   a set may miss and one more (prefix filter). The order is by how many sets, over all documents, have the n-gram, rarest
   first, then by hash. Buckets of documents ask shards of n-grams for these counts; 32 bits of an n-gram travel beside
   its shard, and n-grams that agree in them share a count, which only changes the order, never the result. An n-gram
   of one set alone is no signature.
3. Signatures meet in shards. Each task links its own holders of a signature to the smallest, so a shard gets
   one holder for each task, however large a group is. The links' components are the candidate groups.
4. Groups are joined exactly with prefix trees. A large group, by sets or by n-grams, is cut into chunks by salt, and
   each pair of chunks is one piece of work, so no task holds a whole group. Chunks are as large as a shard's share, so
   that pieces are even; from CHUNKS chunks on they grow up to CHUNK_TOKENS n-grams, so that a text is dealt
   CHUNKS times or as its n-grams demand.
5. Verified links give the components; links of copies are counted by class sizes.

Null or wordless texts have empty sets and link with nothing. Shorter texts are one n-gram. A null id links with
nothing. Rows with equal ids are one document: repeated rows count once in links, and where such rows differ in text,
each row has the links of its own text, and all of them the one component that any of them reaches. Very long texts are
sets like any other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .trie_join import join
from .util import components, cut, parts, text_size

N, NUM, DEN = 3, 90, 100
RATIO = 1.2
SPARE, THIN = 4, 2
FULL = 16  # parts hold FULL / 2 n-grams or more: SPARE and THIN apply
BUCKET_BYTES = 16 << 20  # of text of a bucket, and of the text whose n-grams a shard of counts holds
_EXACT = 200  # counts beyond are told by their logarithm
SMALL = 60  # classes up to this size have few parts, none of them thin; all are sent
CHUNK, CHUNKS = 250, 64  # sets of a chunk; chunks of a group, unless its n-grams demand more
CHUNK_TOKENS = 500_000  # n-grams of a chunk, on average over its group
SHARD_BYTES = 32 << 20
_U64 = np.uint64


def sets(w: K.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat ascending distinct n-gram hashes, sizes) of the documents of a block."""
    h = w.hashes()
    docs = w.documents()
    ok = np.flatnonzero(K.window_mask(w.at, len(h), n))
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    key = np.concatenate([K.gram_hashes(h, n)[ok], K.run_hashes(h, w.at[short], w.at[short + 1])])
    doc = np.concatenate([docs[ok], short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
        key, doc = key[new], doc[new]
    return key, np.bincount(doc, minlength=len(w.counts))


def names(key: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two hashes of each whole set (0 for an empty one)."""
    out, some = np.zeros((2, len(sizes)), _U64), np.flatnonzero(sizes)
    at = (np.cumsum(sizes) - sizes)[some]
    for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47)):
        if len(some):
            out[k, some] = K.mix(np.add.reduceat(K.mix(key ^ _U64(salt)), at) + sizes[some].astype(_U64))
    return out


def _class(n: int) -> int:
    return int(math.log(n) / math.log(RATIO) + 1e-9)


def signatures(own: np.ndarray, num: int, den: int) -> np.ndarray:
    """One hash for each part of the hash space, for the size classes in which partners look (parts of FULL / 2 n-grams or more)."""
    n, out = len(own), []
    # every class from the set's own to that of its largest partner: two partners share the larger one's class
    for k in range(_class(n), _class(max(n, n * den // num)) + 1):
        largest = int(RATIO ** (k + 1)) + 1
        needed = 2 * largest * (den - num) // (den + num) + 1
        spare, thin = SPARE, THIN
        spare = spare if largest > SMALL else 0
        cuts = needed + spare
        part = ((K.mix(own) >> _U64(32)) * _U64(cuts)) >> _U64(32)
        part = part.astype(np.int64)
        total = np.zeros(cuts, _U64)
        np.add.at(total, part, K.mix(own ^ _U64(0x5851F42D4C957F2D)))
        own_sigs = K.mix(total + np.arange(cuts, dtype=_U64) * _U64(0x9E3779B97F4A7C15) + _U64(k << 48))
        thick = np.bincount(part, minlength=cuts) > thin
        out.append(own_sigs[thick] if cuts - np.count_nonzero(thick) <= spare else own_sigs)
    return np.concatenate(out)


def _short(key: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of an n-gram and 32 of its bits."""
    h = K.mix(key)
    return ((h % _U64(n_shards)) << _U64(32)) | (h >> _U64(32))


def _level(n: np.ndarray) -> np.ndarray:
    """A count in one byte, in the same order."""
    return np.where(n <= _EXACT, n, _EXACT + np.log2(np.maximum(n, 1))).astype(np.uint8)


def frequencies(bucketed: DataFrame, n: int, n_shards: int) -> DataFrame:
    """(bucket, shard, levels) of each bucket's distinct n-grams, in the order of _short()."""

    def ask(t: pa.Table) -> pa.Table:
        own = np.sort(np.concatenate([_short(sets(K.Words(offsets, data, lower=True), n)[0], n_shards) for _, _, offsets, data in K.blocks(t)]))
        at = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        times, own = np.diff(np.append(at, len(own))), own[at]
        there, first = np.unique((own >> _U64(32)).astype(np.int64), return_index=True)
        ends = np.append(first, len(own))
        often = np.flatnonzero(times > 1)  # most n-grams of a bucket are in one set of it
        cuts = np.searchsorted(often, ends)
        lists = lambda values, cut: pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(values.astype(np.int32)))
        return pa.table({
            "shard": pa.array(there), "bucket": pa.array(np.full(len(there), t.column("bucket")[0].as_py())), "key": lists((own & _U64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), ends),
            "place": lists(often - np.repeat(first, np.diff(cuts)), cuts), "times": lists(times[often], cuts),
        })

    def add_up(t: pa.Table) -> pa.Table:
        key, sizes = K.flat(t.column("key"), np.int32)
        key, starts = key.view(np.uint32), np.cumsum(sizes) - sizes
        place, often = K.flat(t.column("place"), np.int32)
        count = np.ones(len(key), np.int64)
        count[np.repeat(starts, often) + place] = K.flat(t.column("times"), np.int32)[0]
        order = np.argsort(key)
        fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        level = np.empty(len(key), np.uint8)
        level[order] = _level(np.add.reduceat(count[order], np.flatnonzero(fresh)))[np.cumsum(fresh) - 1]
        return pa.table({"bucket": t.column("bucket"), "shard": t.column("shard"), "levels": pa.array([level[i : i + k].tobytes() for i, k in zip(starts, sizes, strict=True)], pa.binary())})

    asked = bucketed.groupBy("bucket").applyInArrow(ask, "shard long, bucket long, key array<int>, place array<int>, times array<int>")
    return asked.groupBy("shard").applyInArrow(add_up, "bucket long, shard long, levels binary")


def prefixes(key: np.ndarray, sizes: np.ndarray, level: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat n-grams that come first in the global order, how many of each set): one more than a partner may miss, without those of one set."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((key, level, doc))
    most = np.where(sizes > 0, sizes - -(-num * sizes // den) + 1, 0)
    at = order[K.ragged(np.cumsum(sizes) - sizes, most)]
    at = at[level[at] > 1]
    return key[at], np.bincount(doc[at], minlength=len(sizes))


def _stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, smallest holder of each, and links that connect the holders of a key: one for each holder)."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    lead = doc[np.flatnonzero(first)][np.cumsum(first) - 1] if len(key) else doc
    return key[first], doc[first], *K.forest(doc[doc != lead], lead[doc != lead])


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked directly, copies included)."""
    n_shards = parts(text_size(docs, text_col)[1], SHARD_BYTES)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = "doc_id long, n_shingles long, name long, name2 long, sigs array<long>"
    columns = ["doc_id", "n_shingles", "name", "name2", "sigs"]

    def row(ids: pa.Array, key: np.ndarray, sizes: np.ndarray, sigs: np.ndarray, counts: np.ndarray | list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids, pa.array(sizes.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in names(key, sizes)), K.list_array(sigs.view(np.int64), np.cumsum([0, *counts]))], names=columns)

    def by_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, offsets, data in K.blocks(b):
                key, sizes = sets(K.Words(offsets, data, lower=True), n)
                at = np.concatenate([[0], np.cumsum(sizes)])
                each = [signatures(key[at[d] : at[d + 1]], num, den) if sizes[d] else key[:0] for d in range(j - i)]
                yield row(b.column("doc_id")[i:j], key, sizes, np.concatenate(each), [len(x) for x in each])

    def by_prefix(own: pa.Table, told: pa.Table) -> pa.Table:
        """The levels of a bucket line up with its n-grams in the order of _short()."""
        ids, told = own.column("doc_id").combine_chunks(), told.sort_by("shard")
        level = np.frombuffer(b"".join(told.column("levels").to_pylist()), np.uint8)
        blocks = [(i, j, *sets(K.Words(offsets, data, lower=True), n)) for i, j, offsets, data in K.blocks(own)]
        short = K.distinct(np.concatenate([np.zeros(0, _U64), *(_short(key, n_counts) for _, _, key, _ in blocks)]))
        found = [row(ids[i:j], key, sizes, *prefixes(key, sizes, level[np.searchsorted(short, _short(key, n_counts))], num, den)) for i, j, key, sizes in blocks]
        none = pa.schema([*((c, pa.int64()) for c in columns[:4]), ("sigs", pa.list_(pa.int64()))])
        return pa.Table.from_batches(found) if found else none.empty_table()

    if den + num >= FULL * (den - num):
        known = cut(rows.mapInArrow(by_parts, described))
    else:
        n_counts = parts(text_size(docs, text_col)[1], bucket_bytes)
        bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_counts)))
        levels = frequencies(bucketed, n, n_counts)
        known = cut(bucketed.groupBy("bucket").cogroup(levels.groupBy("bucket")).applyInArrow(by_prefix, described))
    some = known.where("n_shingles > 0 and doc_id is not null")
    members = some.select("doc_id", "name", "name2", "n_shingles").distinct()
    classes = cut(members.groupBy("name", "name2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("size")))
    holders = some.join(classes, ["name", "name2"]).where("doc_id = rep").select("name", "name2", "rep", "sigs").dropDuplicates(["name", "name2"]).select("rep", "sigs")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, sizes = K.flat(b.column("sigs"))
            key, lead, one, other = _stars(key.view(_U64), np.repeat(b.column("rep").to_numpy(), sizes))
            there, lists = K.by_shard((key % _U64(n_shards)).astype(np.int64), key, lead)
            count = len(there)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), *lists, *(K.list_array(x[:0], np.zeros(count + 1)) for x in (one, other))], names=["shard", "key", "lead", "a", "b"])
            there, lists = K.by_shard(K.mix(one.view(_U64)).astype(np.int64) % n_shards if len(one) else one, one, other)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), *(K.list_array(x[:0], np.zeros(len(there) + 1)) for x in (one, other)), *lists], names=["shard", "key", "lead", "a", "b"])

    def meet(t: pa.Table) -> pa.Table:
        key, lead = K.flat(t.column("key"))[0].view(_U64), K.flat(t.column("lead"))[0]
        _, _, one, other = _stars(key, lead)
        one, other = K.forest(np.concatenate([one, K.flat(t.column("a"))[0]]), np.concatenate([other, K.flat(t.column("b"))[0]]))
        return pa.table({"a": pa.array(one), "b": pa.array(other)})

    a = "array<long>"
    near = holders.mapInArrow(send, f"shard long, key {a}, lead {a}, a {a}, b {a}").groupBy("shard").applyInArrow(meet, "a long, b long")
    groups = components(near)
    work = _chunked(groups, rows, classes)

    def verify(t: pa.Table) -> pa.Table:
        component, lo, hi, ids, name, copies, side = (t.column(c).to_numpy() for c in ("component", "lo", "hi", "rep", "name", "copies", "side"))
        texts = t.column("text").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
        order = np.lexsort((name, hi, lo, component))
        new = np.concatenate([[True], np.any([x[order][1:] != x[order][:-1] for x in (component, lo, hi)], axis=0)])
        out: list[list[np.ndarray]] = [[], [], [], []]
        for at in np.split(order, np.flatnonzero(new)[1:]):
            key, sizes = _sets_of(texts.take(pa.array(at)), n)
            # the text of this class, once: ids may come with other texts and in several rows
            mine = np.flatnonzero((names(key, sizes)[0].view(np.int64) == name[at]) & np.concatenate([[True], name[at][1:] != name[at][:-1]]))
            own = np.split(key, np.cumsum(sizes)[:-1])
            own, at = [own[k] for k in mine], at[mine]
            if not len(at):
                continue
            both = lo[at[0]] != hi[at[0]]  # two chunks, of which one may be empty: links inside a chunk belong to its own piece of work
            links, label = np.zeros(len(at), np.int64), np.arange(len(at))
            for i, j in join(own, num, den):
                if both:
                    j = j[side[at[j]] != side[at[i]]]
                links[i] += copies[at[j]].sum()
                links[j] += copies[at[i]]
                if len(j):
                    _unite(label, i, j)
            root = np.array([_root(label, k) for k in range(len(at))], np.int64)
            for x, y in zip(out, (ids[at], ids[at[root]], name[at], links), strict=True):
                x.append(y[links > 0])
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for c, x in zip(("a", "b", "name", "links"), out, strict=True)})

    found = cut(work.groupBy("shard").applyInArrow(verify, "a long, b long, name long, links long"))
    # ids with different texts tie their classes together
    several = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    ties = members.join(several, "doc_id").join(classes, ["name", "name2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(found.select("a", "b").union(ties))
    links = found.groupBy(F.col("a").alias("rep"), "name").agg(F.sum("links").alias("links"))
    of = classes.join(joined, classes.rep == joined.node, "left").join(links, ["rep", "name"], "left")
    of = of.select("name", "name2", "copies", F.coalesce("component", "rep").alias("component"), F.coalesce("links", F.lit(0)).alias("links"))
    mine = known.drop("sigs").join(of, ["name", "name2"], "left")
    real = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return mine.select(
        "doc_id", "n_shingles", F.when(real, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(real, F.col("links") + F.col("copies") - 1).otherwise(F.lit(0)).cast("long").alias("n_links")
    )


def _sets_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    found = [sets(K.Words(offsets, data, lower=True), n) for _, _, offsets, data in K.blocks(pa.table({"text": texts}))]
    return np.concatenate([k for k, _ in found]), np.concatenate([s for _, s in found])


def _root(label: np.ndarray, i: int) -> int:
    while label[i] != i:
        label[i] = label[label[i]]
        i = int(label[i])
    return i


def _unite(label: np.ndarray, i: int, others: np.ndarray) -> None:
    roots = {_root(label, int(k)) for k in others} | {_root(label, i)}
    least = min(roots)
    for r in roots:
        label[r] = least


def _chunked(groups: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates with their texts, dealt to pieces of work: shard, component, lo, hi (chunks), side, rep, name, copies, text."""
    held = groups.join(classes.select(F.col("rep").alias("node"), "name", "copies", "size"), "node")
    by_sets = F.least(F.count(F.lit(1)) / CHUNK, F.lit(float(CHUNKS)))
    large = held.groupBy("component").agg(F.ceil(F.greatest(by_sets, F.sum("size") / CHUNK_TOKENS)).alias("chunks"))
    sized = held.drop("size").join(large, "component")
    # each set is dealt once for each chunk of its group, and shards hold as many dealt sets at every size
    n_shards = parts(int(sized.agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("n")).first()["n"]), CHUNK)
    # a merge join at every size: the candidates grow with the input, so they are never broadcast
    texts = sized.join(rows.where("doc_id is not null and text is not null").hint("merge"), sized.node == rows.doc_id).drop("doc_id")
    salted = texts.withColumn("side", F.pmod(F.xxhash64("node", "name"), F.col("chunks")))
    # chunk c meets every chunk from itself on: it takes part in the pieces (lo, hi) of all pairs that name it
    dealt = salted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"lo": F.least("side", "other"), "hi": F.greatest("side", "other")})
    # the pieces of a group go to shards one after another, so that large ones do not meet by chance
    number = F.expr("lo * chunks - lo * (lo - 1) div 2 + hi - lo")
    return dealt.select(F.pmod(F.pmod(F.xxhash64("component"), F.lit(n_shards)) + number, F.lit(n_shards)).alias("shard"), "component", "lo", "hi", "side", F.col("node").alias("rep"), "name", "copies", "text")
