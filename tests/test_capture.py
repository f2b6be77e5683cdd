"""Count-based batches against a plain loop: restarts, ticks, the cap of the backlog, awkward rows."""

import random

import numpy as np
import pytest

from sonolake.functions import dsp
from sonolake.sources import tables
from sonolake.streaming import capture

SCHEMA = "device string, tick long, place long, sample double"


def rule(rows, size, capacity):
    out, state = [], {}
    for device, tick in sorted({(r[0], r[1]) for r in rows if None not in r[:3]}):
        own = state.setdefault(device, {"wait": [], "taken": 0, "dropped": 0})
        own["wait"] += sorted((r[2], r[3]) for r in rows if r[:2] == (device, tick) and r[2] is not None)
        if (over := len(own["wait"]) - capacity) > 0:
            own["wait"], own["dropped"] = own["wait"][over:], own["dropped"] + over
        if len(own["wait"]) >= size:
            batch, own["wait"] = own["wait"][:size], own["wait"][size:]
            out.append((device, own["taken"], batch[0][0], batch[-1][0], size, [x for _, x in batch], own["dropped"]))
            own["taken"] += 1
    return sorted(out)


def run(spark, tmp_path, drops, size, capacity):
    for rows in drops:
        spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        capture.run_captured(capture.capture_batches(stream, size, capacity), f"{tmp_path}/out", f"{tmp_path}/mark")
    return sorted(tuple(r) for r in spark.read.schema(capture.BATCHES).parquet(f"{tmp_path}/out").collect())


def test_a_consumer_that_keeps_up_loses_nothing(spark, tmp_path):
    rows = [("mic", i, i, i / 2) for i in range(22)]
    got = run(spark, tmp_path, [rows[:7], rows[7:8], rows[8:]], 5, 10)
    assert [(r[2], r[3]) for r in got] == [(0, 4), (5, 9), (10, 14), (15, 19)] and got == rule(rows, 5, 10) and all(r[-1] == 0 for r in got)


@pytest.mark.parametrize("seed", [1, 2])
def test_backlog_and_restarts(spark, tmp_path, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), i // 9, i, float(rnd.randrange(100))) for i in range(400)] + [(None, 1, 1, 1.0), ("a", None, 1, 1.0), ("a", 3, None, 1.0)]
    drops = [[r for r in rows if lo <= (r[1] or 0) < hi] for lo, hi in ((0, 11), (11, 12), (12, 99))]
    got = run(spark, tmp_path, drops, 4, 6)
    assert got == rule(rows, 4, 6) and max(r[-1] for r in got) > 0


def test_backlog_of_one_look():
    own = capture.Backlog(np.zeros(0, np.int64), np.zeros(0))
    assert own.look(np.arange(22), np.arange(22.0), 5, 10) == (0, 12, 16, 5, [12.0, 13.0, 14.0, 15.0, 16.0], 12)
    assert own.look(np.arange(0), np.zeros(0), 5, 10)[1:3] == (17, 21) and own.look(np.arange(0), np.zeros(0), 5, 10) is None


def test_ticks_are_taken_in_order(spark, tmp_path):
    """Samples in any order and over several frames, equal places by their order, values that are null; ticks of one sample and of many."""
    rnd = random.Random(7)
    rows = [("m", t, p, None if p % 13 == 0 else p / 4) for p, t in enumerate(sorted(rnd.choice([-3, 0, 5, 5, 5, 1 << 60]) for _ in range(300)))]
    shuffled = rnd.sample(rows, len(rows))
    got = run(spark, tmp_path, [shuffled], 20, 30)
    blank = lambda found: [tuple([None if x is None or x != x else x for x in c] if isinstance(c, list) else c for c in r) for r in found]
    assert len(got) > 2 and blank(got) == blank(rule(rows, 20, 30))


def test_waveforms_are_made_where_they_are_put(spark, tmp_path, monkeypatch):
    """Samples go to Python once, nothing is dealt anew, and no waveform comes back as a column; null and empty samples as before."""
    plans, kind = [], type(spark.range(0))
    real = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda self, *a, **b: (plans.append(self._jdf.queryExecution().executedPlan().toString()), real(self, *a, **b))[1])
    batches = spark.createDataFrame([("a", 0, 0, 3, 4, [0.5, -0.25, None, 0.0], 0), ("a", 1, 4, 7, 4, [], 0), ("b", 0, 0, 0, 4, None, 0)], capture.BATCHES)
    batches.write.parquet(f"{tmp_path}/batches")
    with np.errstate(invalid="ignore"):
        events = capture.produce(spark.read.schema(capture.BATCHES).parquet(f"{tmp_path}/batches"), f"{tmp_path}/z", 4)
        expected = sorted(tables.encode_wav(dsp.normalise(np.asarray(x, float)), 4) for x in ([0.5, -0.25, np.nan, 0.0], [], None))
    assert len(plans) == 1 and "samples" in plans[0] and not any(x in plans[0] for x in ("ArrowEvalPython", "Exchange"))
    assert sorted((tmp_path / f"z/landing/{e.audio_path}").read_bytes() for e in events.collect()) == expected and events.count() == 3


def test_a_batch_has_to_fit(spark):
    with pytest.raises(ValueError):
        capture.capture_batches(spark.createDataFrame([], SCHEMA), 5, 4)
