"""Null ids, repeated rows, long texts, clashing names and empty tables for the operators that have no SQL, and for substrings."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from sonolake.llm import packing, pii
from sonolake.llm import quality as Q
from sonolake.llm import toxicity as X
from sonolake.llm.fim import fill_in_middle
from sonolake.llm.ppm import lm_score
from sonolake.llm.queries import tokenizer_path
from sonolake.llm.substring import substring_dedup
from sonolake.llm.util import held_out

SCHEMA = "doc_id long, text string, piece int, length long, spans string, masked string, n_words long, score double, held_out boolean, label int, bucket long, start long, f string"
LONG = "Write to ann.b@example.org or +49 30 1234567 now, 10.0.0.1 is up. " * 4_000


@pytest.fixture(scope="module")
def docs():
    return [(None, "one two three"), (None, "one two three"), (None, None), (7, "call +49 30 1234567"), (7, "call +49 30 1234567"), (7, "another text of that id"), (8, ""), (9, None), (-3, LONG), (1 << 50, " \n\t")]


@pytest.fixture(scope="module")
def rows(spark, docs):
    return spark.createDataFrame([(i, t, 1, 2, "a", "b", 3, 0.5, True, 1, 4, 5, "f") for i, t in docs], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(7, 1, 0), (8, 0, 1), (None, 1, 1), (12345, 0, 0), (-3, None, None)], "doc_id long, quality int, toxic int")


def test_packing(spark, docs, rows):
    from tokenizers import Tokenizer

    encode, want = Tokenizer.from_file(tokenizer_path()).encode, Counter()
    for i, t in docs:
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    out = packing.pack(packing.pieces(rows, tokenizer_path())).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert packing.pack(packing.pieces(rows.limit(0), tokenizer_path())).count() == 0


def test_pii(docs, rows):
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans)) for r in pii.find_pii(rows).collect())
    assert got == Counter((i, tuple((pii.KINDS[k], a, z) for a, k, z in pii.find(t or ""))) for i, t in docs)
    assert max(len(spans) for _, spans in got) == 12_000 and pii.find_pii(rows.limit(0)).count() == 0
    kept = pii.find_pii(rows, masked=True, keep=True)
    assert "length" in kept.columns and {r.length for r in kept.collect()} == {2}


def test_language_model(docs, rows):
    out = lm_score(rows, bucket_bytes=50_000, shard_bytes=50_000).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in docs) and all(math.isfinite(r.score) and r.score < 0 for r in out)
    by = {}
    for r in out:
        by.setdefault((r.doc_id, r.n_tokens), set()).add((r.base_score, round(r.score, 9)))
    assert len(by[None, 4]) == len(by[7, 5]) == 1 and not any(r.held_out for r in out if r.doc_id is None)
    held = {i for i, _ in docs if i is not None and zlib.crc32(str(i).encode()) % 5 == 1}
    tokens = sum(len((t or "").split()) + 1 for i, t in docs if i not in held)
    assert {r.train_tokens for r in out} == {tokens} and lm_score(rows.limit(0)).count() == 0


def test_classifiers(docs, rows, labels):
    for out, none in ((Q.quality(rows, labels), Q.quality(rows.limit(0), labels)), (X.toxicity(rows, labels), X.toxicity(rows.limit(0), labels))):
        found = out.collect()
        assert Counter(r.doc_id for r in found) == Counter(i for i, _ in docs) and all(0 <= r.score <= 1 for r in found) and none.count() == 0


def test_toxicity_in_chunks(rows, labels, monkeypatch):
    whole = X.fit(rows, labels, "toxic", held_out("doc_id", 4, 2), l1=0.0)
    assert np.count_nonzero(whole)
    monkeypatch.setattr(X, "MOST_FEATURES", 3)
    assert np.count_nonzero(X.fit(rows, labels, "toxic", held_out("doc_id", 4, 2), l1=0.0)) == np.count_nonzero(whole)


def test_fill_in_middle(docs, rows):
    assert Counter(r.doc_id for r in fill_in_middle(rows, 1 << 12).collect()) == Counter(i for i, _ in docs)


def test_substrings(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = spark.createDataFrame([(None, text, 1), (3, text, 1), (3, text, 1), (4, "own " + text, 1), (5, None, 1), (6, f"{text} {LONG}", 1)], "doc_id long, text string, n_words long")
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup(rows).collect())
    n = len(LONG.split())
    assert got == [(0, 20, 20), (3, 20, 0), (3, 20, 0), (4, 21, 20), (5, 0, 0), (6, n + 20, 20)] and substring_dedup(rows.limit(0)).count() == 0
