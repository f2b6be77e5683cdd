"""Ranks, quantiles and closest pairs of whole columns against plain rules."""

import itertools
import random

import numpy as np
import pandas as pd
import pytest

from sonolake.functions import pairs
from sonolake.operators import order


def all_pairs(v, rank):
    found = [(float(np.rint(abs(v[a] - v[b]) * 100.0) / 100.0), *sorted((int(rank[a]), int(rank[b])))) for a, b in itertools.combinations(range(len(v)), 2)]
    return [p[1:] for p in sorted(found)]


def greedy(listed, n):
    out, used = [], set()
    for a, b in listed:
        if len(out) < n and not {a, b} & used:
            out.append((a, b))
            used |= {a, b}
    return out


@pytest.mark.parametrize("seed", range(40))
def test_closest_pairs(seed):
    rnd = random.Random(seed)
    k = rnd.choice([0, 1, 2, 3, 7, 30])
    v = np.array([rnd.choice([rnd.random(), rnd.randrange(3) / 200, round(rnd.random(), 2)]) * rnd.choice([1, 1, 100]) for _ in range(k)])
    rank = np.array(rnd.sample(range(k), k), int)
    want = all_pairs(v, rank)
    for n in (1, 4, 10):
        assert pairs.closest(v, rank, n) == want[:n] and pairs.matched(v, rank, n) == greedy(want, n)


def test_many_equal_numbers_are_quick():
    v, rank = np.zeros(200_000), np.arange(200_000)[::-1].copy()
    assert pairs.closest(v, rank, 3) == [(0, 1), (0, 2), (0, 3)] and pairs.matched(v, rank, 2) == [(0, 1), (2, 3)]


def test_dense_rank(spark, tmp_path):
    rows = [(i, random.Random(i).choice([None, 0.0, -0.0, 1.5, float(i % 7), -2.0])) for i in range(300)]
    got = order.dense_rank(spark.createDataFrame(rows, "id int, x double").repartition(5), "x", str(tmp_path / "r")).collect()
    ranked = pd.Series([x for _, x in sorted(rows)], dtype=float).rank(method="dense", ascending=False)
    assert len(got) == 300 and all((r.rank is None) if np.isnan(ranked[r.id]) else r.rank == ranked[r.id] for r in got)
    plan = order.dense_rank(spark.createDataFrame(rows, "id int, x double"), "x", str(tmp_path / "q"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan.split("before")[0]


def test_description(spark, tmp_path):
    rnd = random.Random(3)
    frame = pd.DataFrame({"a": [rnd.choice([None, rnd.random(), 2.0, 2.0]) for _ in range(200)], "b": [float(i % 3) for i in range(200)], "c": [None] * 199 + [4.0]})
    got = {r.column_name: r for r in order.description(spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "a double, b double, c double").repartition(4), ["a", "b", "c"], str(tmp_path)).collect()}
    want = frame.astype(float).describe()
    for c in frame:
        for mine, his in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
            x, y = got[c][mine], want[c][his]
            assert (x is None and np.isnan(y)) or abs(x - y) < 1e-12
    one = order.description(spark.createDataFrame([], "a double"), ["a"], str(tmp_path / "none"))
    assert one.count() == 0
