"""Quality by a sparse rule ensemble.

1. Statistics of each text, in numpy over whole blocks.
2. On at most MOST_ROWS labelled rows that are not held out (a documented bound): shallow boosted trees; every path
   from a root is a rule, a conjunction of comparisons on statistics; lasso logistic regression weighs the rules.
3. The rules with a weight become one Spark column expression over the statistics.

Null and empty texts have all statistics 0; texts of any length are read whole. Repeated rows are scored each, and an id with
several texts is learnt from one of them, that of the smallest hash. Labels without a document and null labels or ids are
not learnt from. Without labels the score is 0.5. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .labelled import one_each, sample
from .util import held_out

MOST_ROWS = 8000
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
PENALTY = 0.001
STATS = (
    "n_bytes", "n_words", "word_length", "upper_share", "digit_share", "mark_share", "odd_share", "bare_odd_share", "line_length",
    "distinct_share", "repeat_share", "top_share", "marked_words", "longest_word", "short_share", "same_lines",
)

_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_MARK = np.array([b in b".,;:!?'\"()-" for b in range(256)])
_ODD = np.array([32 < b < 127 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b in b".,;:!?'\"()-") for b in range(256)])
_LINE = np.array([b != 10 for b in range(256)])


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of STATS for each document of a block."""
    docs, size = len(offsets) - 1, np.diff(offsets)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    w, lines = K.Words(offsets, data), K.Words(offsets, data, _LINE)
    doc, lengths = w.documents(), w.ends - w.starts
    h = w.hashes()
    n = np.maximum(w.counts, 1).astype(float)
    n_lines = np.maximum(lines.counts, 1).astype(float)
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(fresh, len(key)))
    of = (key[fresh] >> np.uint64(44)).astype(np.int64)
    top = np.zeros(docs)
    np.maximum.at(top, of, times)
    again = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    line_key = K.distinct((lines.documents().astype(np.uint64) << np.uint64(44)) | (lines.hashes() >> np.uint64(20)))
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, lengths)
    letters = np.maximum(per_doc(_LETTER[data]), 1)
    size1 = np.maximum(size, 1).astype(float)
    odd = _ODD[data]
    ends_odd = odd[w.ends - 1] if len(w) else np.zeros(0, bool)
    bare = ends_odd & (lengths == 1)
    return np.stack([
        size.astype(float), w.counts.astype(float), np.bincount(doc, lengths, docs) / n, per_doc(_UPPER[data]) / letters, per_doc(_DIGIT[data]) / size1, per_doc(_MARK[data]) / size1, per_doc(odd) / size1,
        np.bincount(doc[bare], minlength=docs) / n, np.bincount(lines.documents(), lines.ends - lines.starts, docs) / n_lines,
        np.bincount(of, minlength=docs) / n, np.bincount(doc[1:][again], minlength=docs) / n, top / n, np.bincount(doc[ends_odd], minlength=docs) / n, longest,
        np.bincount(doc[lengths <= 2], minlength=docs) / n, 1 - np.bincount((line_key >> np.uint64(44)).astype(np.int64), minlength=docs) / n_lines * (lines.counts > 0) - (lines.counts == 0),
    ], axis=1)


def with_statistics(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The kept columns and a double column for each of STATS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, offsets, data in K.blocks(b):
                s = statistics(offsets, data)
                yield pa.RecordBatch.from_arrays([*(b.column(c)[i:j] for c in keep), *(pa.array(c.copy()) for c in s.T)], names=[*keep, *STATS])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} double" for c in STATS)]))


Rule = tuple[tuple[int, float, bool], ...]  # (statistic, bound, above it)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, bound, above in rule:
        out &= (x[:, k] > bound) == above
    return out


def boosted_paths(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct paths of gradient-boosted trees of logistic loss."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        grown: list[tuple[np.ndarray, Rule]] = [(np.arange(len(y)), ())]
        for _ in range(DEPTH):
            new = []
            for rows, path in grown:
                best = (1e-3, -1, -1)
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
                for k, c in enumerate(cuts):
                    if not len(c):
                        continue
                    sg = np.cumsum(np.bincount(binned[rows, k], g[rows], len(c) + 1))
                    sh = np.cumsum(np.bincount(binned[rows, k], h[rows], len(c) + 1))
                    gain = sg[:-1] ** 2 / (sh[:-1] + 1) + (sg[-1] - sg[:-1]) ** 2 / (sh[-1] - sh[:-1] + 1) - whole
                    at = int(gain.argmax())
                    best = max(best, (float(gain[at]), k, at))
                if best[1] < 0 or len(rows) < 20:
                    new.append((rows, path))
                    continue
                _, k, at = best
                above = binned[rows, k] > at
                for side in (False, True):
                    rule = (*path, (k, float(cuts[k][at]), side))
                    rules[rule] = None
                    new.append((rows[above == side], rule))
            grown = new
        for rows, _ in grown:
            if len(rows):
                margin[rows] += RATE * g[rows].sum() / (h[rows].sum() + 1)
    return list(rules)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """(weights, bias) of L1-penalised logistic regression, by accelerated proximal gradients."""
    if not r.shape[1]:
        r = np.zeros((len(y), 1))
    a = np.column_stack([r, np.ones(len(y))])
    v = np.ones(a.shape[1])
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / (1.1 * np.linalg.norm(a.T @ (a @ v)))
    x = z = np.zeros(a.shape[1])
    t = 1.0
    for _ in range(rounds):
        new = z - step * (a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -35, 35))) - y)) / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, z, t = new, new + (t - 1) / nt * (new - x), nt
    return x[:-1][: r.shape[1]], float(x[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str, held, most_rows: int = MOST_ROWS) -> tuple[list[tuple[Rule, float]], float]:
    """([(rule, weight)], bias)."""
    rows = with_statistics(sample(docs, labels, label, held, most_rows), ("doc_id", "label", "pick"))
    t = one_each(rows, "label", *STATS).toArrow().sort_by("doc_id")
    if not len(t):
        return [], 0.0
    x, y = np.stack([t.column(c).to_numpy() for c in STATS], axis=1), t.column("label").to_numpy().astype(float)
    rules = boosted_paths(x, y)
    weights, bias = lasso(np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0)), y)
    return [(r, float(w)) for r, w in zip(rules, weights, strict=False) if w], bias


def compiled(rules: list[tuple[Rule, float]], bias: float) -> Column:
    """The score as a column expression over STATS."""
    total = F.lit(bias)
    for rule, weight in rules:
        test = F.lit(True)
        for k, bound, above in rule:
            test = test & ((F.col(STATS[k]) > bound) if above else (F.col(STATS[k]) <= bound))
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, threshold: float = 0.5, most_rows: int = MOST_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    rules, bias = fit(docs, labels, label, held_out("doc_id", modulus, remainder), most_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out("doc_id", modulus, remainder).alias("held_out"))
    scored = with_statistics(rows, ("doc_id", "held_out")).select("doc_id", "held_out", compiled(rules, bias).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
