"""Substring, n-gram and embedding de-duplication against brute force."""

import hashlib
import random

import numpy as np
import pytest

from sonolake.llm import ngram_join as nj
from sonolake.llm.embed_dedup import embedding_dedup
from sonolake.llm.fmindex import FMIndex, WaveletMatrix
from sonolake.llm.substring import _apart, substring_dedup
from sonolake.llm.trie_join import join
from sonolake.llm.util import components

from .common import SPACED, awkward, frame, low


def substring_rule(docs, n=13):
    words = {i: SPACED.findall(t or "") for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def near_rule(docs, n=3, num=90):
    sets = {}
    for i, t in docs:
        w = SPACED.findall(low(t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root, links = {i: i for i in sets}, dict.fromkeys(sets, 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), links[i]) for i, s in sets.items()}


def test_substring(spark):
    docs = awkward()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(frame(spark, docs), with_text=True).collect() if hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256}
    assert got == substring_rule(docs)


@pytest.mark.parametrize("hot", [8, 20_000])
def test_substring_of_a_stock_sentence(spark, hot):
    rnd, stock = random.Random(6), " ".join(f"s{i}" for i in range(16))
    line = lambda k: " ".join(f"u{rnd.randrange(10**6)}" for _ in range(k))
    docs = awkward() + [(500 + i, f"{line(9)} {stock} {line(9)}") for i in range(80)]
    docs += [(700 + i, docs[-80 + 3 * i][1] + " " + line(4)) for i in range(20)]
    got = substring_dedup(frame(spark, docs), hot=hot, bucket_bytes=6000, shard_bytes=3000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == substring_rule(docs)


def test_windows_of_a_hot_minimiser_are_dealt_apart():
    run, window = _apart(np.array([3, 1, 2]), np.array([True, False, False]))
    assert (run.tolist(), window.tolist()) == ([0, 0, 0, 1, 2], [0, 1, 2, 0, 0])


def test_substring_of_nothing(spark):
    assert substring_dedup(frame(spark, awkward()).limit(0)).count() == 0


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"q{i}" for i in range(20))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup(rows).collect()) == [(-1, 20), (5, 0), (5, 0)]


@pytest.mark.parametrize("chunk", [1200, 4])
def test_ngram_join(spark, monkeypatch, chunk):
    monkeypatch.setattr(nj, "CHUNK", chunk)
    docs = awkward()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in nj.ngram_join(frame(spark, docs)).collect()}
    assert got == near_rule(docs)


@pytest.mark.parametrize("tokens", [1_000_000, 500])
def test_ngram_join_of_other_lengths_and_thresholds(spark, monkeypatch, tokens):
    monkeypatch.setattr(nj, "CHUNK_TOKENS", tokens)
    rnd = random.Random(8)
    docs = awkward()
    for g in range(4):  # texts that contain one another, so that partners differ in size as far as they may
        long = [f"k{g}x{i}" for i in range(rnd.choice([90, 260, 700]))]
        docs += [(1000 + 20 * g + k, " ".join(long[: len(long) * (100 - 5 * k) // 100])) for k in range(10)]
    for n, num in ((5, 80), (3, 60)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in nj.ngram_join(frame(spark, docs), n=n, num=num, bucket_bytes=tokens * 20).collect()}
        assert got == near_rule(docs, n, num)


def test_ngram_join_of_repeated_ids(spark):
    t, near, other = (" ".join(f"{c}{i}" for i in range(60)) for c in "tto")
    near += " end"
    rows = spark.createDataFrame([(1, t), (1, t), (2, near), (3, other), (1, other), (5, other), (5, "v w x y z"), (6, "v w x y z"), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.n_links) for r in nj.ngram_join(rows).collect())
    assert got == [(0, 58, 0, 0), (1, 58, 1, 1), (1, 58, 1, 1), (1, 58, 1, 2), (2, 59, 1, 1), (3, 58, 1, 2), (5, 3, 1, 1), (5, 58, 1, 2), (6, 3, 1, 1)]


def test_pieces_of_a_large_group_are_even(spark):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(80)]
    docs = [(i, " ".join(x if rnd.random() > 0.004 else f"y{rnd.randrange(10**6)}" for x in base)) for i in range(1500)]
    seen = {}
    chunked = nj._chunked

    def watched(*args):
        work = chunked(*args)
        seen["rows"] = [r["count"] for r in work.groupBy("component", "lo", "hi").count().collect()]
        return work

    nj._chunked = watched
    try:
        got = nj.ngram_join(frame(spark, docs)).where("n_links > 0").count()
    finally:
        nj._chunked = chunked
    assert got > 1200 and max(seen["rows"]) < 2.6 * nj.CHUNK


def test_ngram_join_of_nothing(spark):
    assert nj.ngram_join(frame(spark, awkward()).limit(0)).count() == 0


def test_prefix_tree_finds_every_pair():
    rnd = random.Random(5)
    for _ in range(30):
        base = rnd.sample(range(1, 10_000), 40)
        sets = [np.array(sorted({*rnd.sample(base, rnd.randint(30, 40)), *rnd.sample(range(1, 10_000), rnd.randint(0, 3))}), np.uint64) for _ in range(25)]
        want = {(i, j) for i in range(25) for j in range(i + 1, 25) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
        assert {(i, int(k)) for i, js in join(sets, 80, 100) for k in js} == want


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 11, 500)
    w = WaveletMatrix(s, 11)
    symbol, at = rng.integers(0, 11, 200), rng.integers(0, 501, 200)
    assert w.rank(symbol, at)[0].tolist() == [int((s[:p] == c).sum()) for c, p in zip(symbol, at, strict=True)]


def test_backward_search_statistics():
    rng = np.random.default_rng(2)
    lengths = rng.integers(5, 30, 40)
    tokens = rng.integers(1, 4, int(lengths.sum())).astype(np.uint64)
    pieces = np.split(tokens, np.cumsum(lengths)[:-1])
    windows, least = FMIndex(tokens, lengths, 5, np.arange(40)[::-1].copy()).statistics()
    want = {}
    for i, p in enumerate(pieces):
        for k in range(len(p) - 4):
            want[tuple(p[k : k + 5])] = min(want.get(tuple(p[k : k + 5]), 99), 39 - i)
    assert windows.tolist() == [len(p) - 4 for p in pieces]
    assert least.tolist() == [want[tuple(p[k : k + 5])] for p in pieces for k in range(len(p) - 4)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 60)] + [(5, 5)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 60)}, 5: 5}


@pytest.mark.parametrize("tile", [4096, 20])
def test_embeddings(spark, tile):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    x = [(i, (centre[i % 6] + rng.normal(size=16) * 0.25 * (i % 5)).tolist()) for i in range(120)]
    x += [(200, x[3][1]), (201, x[3][1]), (202, [2 * v for v in x[3][1]])]
    bad = [(300, None), (301, [0.0] * 16), (302, [None] + [1.0] * 15), (303, [float("nan")] * 16), (304, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup(spark.createDataFrame(x + bad, "vec_id long, embedding array<double>"), tile=tile).collect()}
    ids, m = [i for i, _ in x], np.array([v for _, v in x])
    m /= np.linalg.norm(m, axis=1)[:, None]
    near = (m @ m.T >= 0.9) & ~np.eye(len(ids), dtype=bool)
    label = np.array(ids)
    for _ in ids:
        label = np.minimum(label, np.where(near, label[None, :], 10**6).min(axis=1))
    want = {i: (int(near[k].sum()), int(label[k]), bool(label[k] == i)) for k, i in enumerate(ids)}
    assert got == want | {i: (0, i, True) for i, _ in bad}
    assert embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_embeddings_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.1], 0), (3, [1.0, 0.0, 0.0], 0), (4, [2.0, 0.0, 0.0], 0), (4, [2.0, 0.0, 0.0], 0), (5, [1.0], 0), (None, [1.0, 0.0], 0), (6, [], 0), (7, [-0.0, 1.0], 0), (8, [0.0, 1.0], 0)]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, own long")).collect())
    assert got == [(0, 0, 0), (1, 1, 1), (2, 1, 1), (3, 2, 3), (4, 2, 3), (4, 2, 3), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7)]


def test_tiles_of_vectors_are_not_sent_to_their_pairs(spark):
    """A vector is shuffled once, however many tiles its own is compared with."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, 32)).astype(np.float32)
    x[1000:1010] = x[:10] * np.float32(1.5)  # equal but for their length
    x[1990:] = x[:10]
    shuffled = lambda: sum(s.shuffleWriteBytes() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, quantiles, None)))
    sc = spark.sparkContext
    store, quantiles = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    df, before = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"), shuffled()
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, tile=50).collect()}  # 40 tiles
    assert shuffled() - before < 3 * x.nbytes
    assert got == {i: (2, i % 1000 if i < 1010 else i - 1990) if i % 1000 < 10 or i >= 1990 else (0, i) for i in range(2000)}
