"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct single words, word pairs and pairs with one word between, of lower-cased alphanumeric words, hashed to
2**BITS. Per-coordinate rates and the L1 term leave few weights; those are broadcast (at most 2**BITS).
Fitting uses at most MOST_ROWS labelled rows that are not held out (a documented bound), in an order given by their ids; their
features are stored, and read by the driver in chunks of about MOST_FEATURES (by a hash of the ids) for each pass; every
text is scored whole. Null and empty texts score the bias alone. Repeated rows are scored each, and an id with several
texts is learnt from one of them, that of the smallest hash. Labels without a document and null labels or ids are not
learnt from. Without labels every score is 0.5. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .labelled import one_each, sample
from .util import cut, held_out, parts

BITS = 20
MOST_ROWS, MOST_FEATURES = 12000, 16 << 20
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 10.0, 0.5, 4
_BIAS = 1 << BITS
_U64 = np.uint64


def features(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, document of each), not yet distinct."""
    h, doc = w.hashes(), w.documents()
    found, docs = [h], [doc]
    for gap, salt in ((1, 0xD1342543DE82EF95), (2, 0xAF251AF3B0F025B5)):
        if len(h) > gap:
            own = doc[gap:] == doc[:-gap]
            found.append(K.mix(h[:-gap] * _U64(salt) + h[gap:])[own])
            docs.append(doc[gap:][own])
    return (np.concatenate(found) >> _U64(64 - BITS)).astype(np.int64), np.concatenate(docs)


class Ftrl:
    def __init__(self, size: int = (1 << BITS) + 1, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labels: DataFrame, label: str, held, most_rows: int = MOST_ROWS, l1: float = L1, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one is the bias)."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, offsets, data in K.blocks(b):
                f, doc = features(K.Words(offsets, data, K.ALNUM, lower=True))
                both = K.distinct((doc << BITS) | f)
                ends = np.searchsorted(both, np.arange(j - i + 1) << BITS)
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("label")[i:j], b.column("pick")[i:j], pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((both & (_BIAS - 1)).astype(np.int32)))], names=["doc_id", "label", "pick", "f"])

    stored = cut(one_each(sample(docs, labels, label, held, most_rows).mapInArrow(hashed, "doc_id long, label int, pick long, f array<int>"), "label", "f"))
    model, kept = Ftrl(l1=l1), {}
    chunks = parts(stored.agg(F.coalesce(F.sum(F.size("f")), F.lit(0))).first()[0], MOST_FEATURES)
    for _ in range(epochs):
        for chunk in range(chunks):
            rows = kept.get(chunk) or _chunk(stored, chunk, chunks)
            if chunks == 1:
                kept[chunk] = rows
            for at, y in zip(*rows, strict=True):
                model.learn(np.append(at, _BIAS), y)
    return model.weights()


def _chunk(stored: DataFrame, chunk: int, chunks: int) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels of a chunk of the rows, which are in the order of a hash of their ids."""
    own = F.floor(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) * chunks / (1 << 20)) == chunk
    t = stored.where(own).toArrow()
    h = t.column("doc_id").to_numpy().astype(_U64)
    order = np.argsort(K.mix(h))
    f = t.column("f").combine_chunks()
    flat, ends = f.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(f.offsets.to_numpy()))])
    return [flat[ends[k] : ends[k + 1]] for k in order.tolist()], t.column("label").to_numpy()[order].astype(int).tolist()


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, remainder: int = 2, threshold: float = 0.3, most_rows: int = MOST_ROWS, l1: float = L1) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    weights = fit(docs, labels, label, held_out("doc_id", modulus, remainder), most_rows, l1)
    shared = docs.sparkSession.sparkContext.broadcast((some := np.flatnonzero(weights), weights[some]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(_BIAS + 1)
        w[shared.value[0]] = shared.value[1]
        for b in batches:
            for i, j, offsets, data in K.blocks(b):
                f, doc = features(K.Words(offsets, data, K.ALNUM, lower=True))
                some = w[f] != 0
                both = K.distinct((doc[some] << BITS) | f[some])
                total = np.bincount(both >> BITS, w[both & (_BIAS - 1)], j - i) + w[_BIAS]
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], b.column("held_out")[i:j], pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", modulus, remainder).alias("held_out"))
    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
