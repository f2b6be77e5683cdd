"""Cleaning, KPI, zone and signal rules on small awkward frames."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonolake.functions import dsp
from sonolake.functions.clean import no_sentinel, np_round, to_number
from sonolake.operators import features, zones
from sonolake.plans import kpi
from sonolake.sources import observations as obs
from sonolake.streaming import hot


def test_sentinels_are_case_sensitive(spark):
    df = spark.createDataFrame([(x,) for x in ("", " ", "-", "nan", "None", "NONE", "NaN", None, "\train\n")], "x string")
    assert [r[0] for r in df.select(no_sentinel(F.col("x"))).collect()] == [None] * 5 + ["NONE", "NaN", None, "rain"]


def test_numbers(spark):
    df = spark.createDataFrame([(x,) for x in ("12", " 12 ", "1e3", "NaN", "1.0d", "1_000", "0x1A", "True", "", None, ".5", "-3.")], "x string")
    assert [r[0] for r in df.select(to_number(F.col("x"))).collect()] == [12.0, 12.0, 1000.0, None, None, None, None, None, None, None, 0.5, -3.0]


def test_rounding_is_numpys(spark):
    x = [0.5, 1.5, 2.5, 0.00005, 0.00015, 0.12345, -1.5]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for d in (0, 2, 4):
        assert [r[0] for r in df.select(np_round(F.col("x"), d)).collect()] == [float(np.round(v, d)) for v in x]


def _frame(spark, rows):
    rows = [(f"u{k}", c, s, p, 0.5, 0.5, t, t, t) for k, (c, s, p, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "uuid string, category string, source string, peak_frequency_hz string, symmetry_score double, pattern_stability_score double, processing_time_seconds double, spectral_entropy double, spectral_centroid_hz double")


ALL = ("frequency_clusters", "cluster_top_categories", "mode_frequency", "top_mode_share", "frequency_detail", "best_candidates", "category_pairs", "closest_pairs", "closest_pairs_unique", "processing_time", "complex_categories", "complex_recordings", "bright_dark_categories", "bright_dark_full")


@pytest.mark.parametrize("name", ALL)
def test_empty_frames_stay_typed(spark, name):
    out = getattr(kpi, name)(_frame(spark, [("a", "s", "1", 1.0)]).limit(0))
    assert out.columns and out.count() == 0


def test_mode_takes_the_lowest_of_equal_counts(spark):
    out = kpi.mode_frequency(_frame(spark, [("a", "s", p, 1.0) for p in ("300", "100.4", "100", "299.6", "7")])).collect()
    assert [(r.frequency_hz_rounded, r.occurrence_count, r.share) for r in out] == [(100, 2, 0.4)]


def test_single_rows_have_no_deviation(spark):
    out = kpi.processing_time(_frame(spark, [("a", "one", "1", 2.0), ("a", "-", "1", 3.0)])).collect()
    assert [(r.source, r.std_seconds) for r in out] == [("one", None)]


def test_matching_uses_each_category_once(spark):
    out = kpi.closest_pairs_unique(_frame(spark, [(c, "s", str(p), 1.0) for c, p in (("a", 1), ("b", 2), ("c", 3), ("d", 10), ("e", 100))])).orderBy("rank").collect()
    assert [(r.category_a, r.category_b, r.difference, r["rank"]) for r in out] == [("a", "b", 1.0, 1), ("c", "d", 7.0, 2)]


def test_latest_puts_nulls_last(spark):
    rows = spark.createDataFrame([("k", None, "z"), ("k", "2024-01-01", "a"), ("k", "2024-01-01", "b"), ("m", None, None)], "uuid string, time_recorded string, source_id string")
    assert sorted((r.uuid, r.source_id or "") for r in zones.latest(rows, ["uuid"], "time_recorded", "source_id").collect()) == [("k", "b"), ("m", "")]


def test_pending_twice_is_empty(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "uuid string").where("uuid is not null")
    assert zones.pending(rows, rows).count() == 0
    assert zones.required_keys(rows, "uuid", "audio_path").count() == 0


def test_paths(spark):
    df = spark.createDataFrame([("audio/hot-path/raw/x1.wav",), ("plain",), ("a/b.mp3",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(zones.uuid_of_path(F.col("p"))).collect()] == ["x1", "plain", "b.mp3", None, None]


def test_aliases_round_trip(spark):
    df = spark.createDataFrame([("t", 1.0)], "`time_recorded/added` string, `processing_time(seconds)` double")
    assert obs.with_boundary_names(obs.with_internal_names(df)).columns == df.columns


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1, 1, allow_nan=False, width=32), max_size=200))
def test_feature_bounds(x):
    f = dsp.spectral(dsp.normalise(np.array(x, float)), 64)
    assert 0 <= f["zero_crossing_rate"] <= 1 and 0 <= f["spectral_centroid_hz"] <= 32 + 1e-6 and all(math.isfinite(v) for v in f.values())


def test_pure_tone():
    rate = 8000
    x = np.sin(2 * np.pi * 440 * np.arange(rate) / rate)
    assert abs(dsp.spectral(x, rate)["spectral_centroid_hz"] - 440) < 1
    assert abs(dsp.peak_frequency(x, rate)["peak_frequency_hz"] - 440) <= 4
    assert dsp.harmonic_ratio(x, rate, 440.0) > 0.99
    assert len(dsp.mfcc_mean(x, rate)) == 13 and dsp.mfcc_mean(x[:100], rate) == [0.0] * 13


def test_peaks_by_hand():
    y = np.array([0, 1, 0, 3, 3, 3, 0, 2, 0, 0.01, 0])
    assert dsp.local_peaks(y, 0.5, 1, 0.5).tolist() == [1, 4, 7]
    assert dsp.local_peaks(y, 0.5, 4, 0.5).tolist() == [4]


def test_strongest_peaks():
    rate = 8000
    t = np.arange(rate) / rate
    x = np.sin(2 * np.pi * 440 * t) + 0.5 * np.sin(2 * np.pi * 1000 * t)
    assert dsp.peak_frequency(x, rate)["peaks_hz"] == "440|1000" and dsp.peak_frequency(x[:60], rate)["peaks_hz"] == ""
    rms, spatial, magnitude, f0 = dsp.frame_profile(x[:800], 15, rate)
    assert f0 == 440 and len(spatial) == len(magnitude) == 2 and abs(rms - np.sqrt(0.625)) < 1e-9
    assert np.allclose(spatial, [2.5 + np.sqrt(k / 401) * 15 for k in (44, 100)])
    assert dsp.frame_profile(x[:60], 22, rate) == (0.0, [13.5], [1.0], 0.0)


def test_lengths_and_frames(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0], 2), ("b", None, 2), ("c", [], 2)], "uuid string, samples array<double>, sample_rate int")
    assert {r.uuid: r.samples for r in features.fit_length(rows, 1).collect()} == {"a": [1.0, 2.0], "b": None, "c": [0.0, 0.0]}
    assert {r.uuid: r.samples for r in features.fit_length(rows, 2).collect()}["a"] == [1.0, 2.0, 3.0, 0.0]
    assert [(r.uuid, r.frame, r.magnitude) for r in features.frame_profiles(rows, 1).collect()] == [("a", 0, [1.0])]
    assert {r.uuid: r[1] for r in features.harmonic_share(rows, F.lit(1.0)).collect()}["c"] == 0.0


def test_filters_with_nulls(spark):
    rows = spark.createDataFrame([("Rain fall",), (None,), ("dog",)], "c string")
    assert [r.c for r in zones.matching(rows, "c", "rain|cat").collect()] == ["Rain fall"]
    assert zones.only(rows, "c", []).count() == 0 and zones.since(rows, "c", None).count() == 3


def test_merge_metrics(spark):
    rows = spark.createDataFrame([("a", "hot-path"), ("a", "x"), ("b", " HOT-path "), (" ", "hot-path"), (None, None)], "uuid string, source string")
    events = spark.createDataFrame([("a",), ("a",), ("z",), (None,)], "uuid string")
    assert tuple(zones.merge_metrics(rows, events).first()) == (2, 2, 1, 2)
    assert tuple(zones.merge_metrics(rows.limit(0), events.limit(0)).first()) == (0, 0, 0, 0)


def test_window_energy_is_the_spectrums(spark):
    rng = np.random.default_rng(3)
    rows = [("e", rng.normal(size=60).tolist(), 40), ("o", rng.normal(size=60).tolist(), 44), ("s", rng.normal(size=7).tolist(), 40)]
    got = features.sliding_windows(spark.createDataFrame(rows, "uuid string, samples array<double>, sample_rate int")).collect()
    by = {u: (np.array(x), r) for u, x, r in rows}
    assert len(got) > 10
    for r in got:
        x, rate = by[r.uuid]
        w = int(rate * 0.25) if len(x) > int(rate * 0.25) else len(x)
        assert np.isclose(r.energy, (np.abs(np.fft.rfft(x[r.offset : r.offset + w])) ** 2).sum())


def test_bins_are_rounded():
    rate = 1000
    x = np.sin(2 * np.pi * 99.6 * np.arange(1000) / rate)
    assert dsp.peak_frequency(np.concatenate([x]), rate)["peak_frequency_hz"] == 100.0


def test_blank_times_are_empty(spark):
    rows = spark.createDataFrame([("a", " "), ("b", None), ("c", "t")], "uuid string, time_recorded string")
    events = spark.createDataFrame([("a", "mic", " ")], "uuid string, device string, event_time string")
    assert {r.uuid: (r.device, r.time_recorded) for r in zones.merge_events(rows, events).collect()} == {"a": ("mic", ""), "b": ("-", ""), "c": ("-", "t")}


def test_votes():
    assert dsp.vote([(440, 1.0), (880, 1.0), (300, 1.5)]) == 440
    assert dsp.vote([]) == 0
    assert dsp.windows(100, 100) == [(o, 25) for o in range(0, 75, 12)]


def test_failing_rows_keep_null_features(spark):
    rows = spark.createDataFrame([("a", [0.0, 1.0, 0.0, -1.0], 4), ("b", None, 4), ("", [1.0], 1)], "uuid string, samples array<double>, sample_rate int")
    got = {r.uuid: r.signal_energy for r in features.with_features(rows).collect()}
    assert got["a"] == 2.0 and got["b"] is None and set(got) == {"a", "b"}


def test_stream_equals_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert hot.replay(hot.tumbling(hot.event_stream(spark, sf)), "complete").agg(F.sum("n")).first()[0] == events.count()
    assert hot.replay(hot.unique_events(hot.event_stream(spark, sf)), "append").count() == events.select("event_id").distinct().count()


def test_appended_rows_stay_out_of_the_driver(spark, sf):
    out = hot.replay(hot.unique_events(hot.event_stream(spark, sf)).select("event_id", "user_id", "event_type"), "append")
    assert out.inputFiles() and out.columns == ["event_id", "user_id", "event_type"]
    assert hot.replay(hot.unique_events(hot.event_stream(spark, sf)).where("false"), "append").count() == 0


def test_ingest_twice_adds_nothing(spark, sf, tmp_path):
    path, rejected = f"{tmp_path}/t", f"{tmp_path}/r"
    for run in ("a", "b"):  # the second run starts over without a checkpoint
        hot.ingest(hot.event_stream(spark, sf), path, rejected, f"{tmp_path}/{run}")
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert spark.read.parquet(path).count() == events.select("event_id").distinct().count()
    assert spark.read.parquet(rejected).count() == 2 * events.where("event_id is null").count()


def test_ingest_by_date_reads_the_dates_in_reach(spark, tmp_path):
    def batch(name, rows):
        spark.createDataFrame(rows, "k string, t string").write.parquet(f"{tmp_path}/in/{name}")
        hot.ingest(spark.readStream.schema("k string, t string").parquet(f"{tmp_path}/in/{name}"), path, f"{tmp_path}/r", f"{tmp_path}/mark-{name}", "k", "t")

    path = f"{tmp_path}/t"
    batch("a", [("1", "2024-01-01"), ("1", "2024-01-01"), ("2", "2024-02-01"), ("3", None), (None, "2024-01-01")])
    batch("b", [("1", "2024-01-02"), ("2", "2024-03-01"), ("3", None), ("4", "2024-01-02")])  # 2 comes back out of reach
    batch("c", [("5", None)])
    got = sorted((r.k, str(r.day)) for r in spark.read.parquet(path).collect())
    assert got == [("1", "2024-01-01"), ("2", "2024-02-01"), ("2", "2024-03-01"), ("3", "None"), ("4", "2024-01-02"), ("5", "None")]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_best_window_is_no_window_of_bin_zero():
    rate = 800
    x = 0.3 * np.sin(2 * np.pi * 40 * np.arange(rate) / rate)
    x[:200] = 1.0  # the loudest window is constant: its bin is 0
    assert dsp.peak_frequency(x, rate)["peak_time_s"] > 0 and dsp.peak_frequency(x, rate)["peaks_hz"] != "0"


def test_numbers_are_finite(spark):
    df = spark.createDataFrame([("1e400", float("inf")), ("2", 2.0), ("inf", float("-inf")), ("x", float("nan"))], "a string, b double")
    assert [tuple(r) for r in df.select(to_number(F.col("a")), kpi.number(df, "b")).collect()] == [(None, None), (2.0, 2.0), (None, None), (None, None)]


def test_peaks_by_plain_rules():
    """Plateaus, ties, distances and prominences as a loop over all values finds them; also of short and flat input."""

    def plain(y, height, distance, prominence):
        n, found, i = len(y), [], 0
        while i < n:
            j = i
            while j + 1 < n and y[j + 1] == y[i]:
                j += 1
            if i > 0 and j + 1 < n and y[i - 1] < y[i] > y[j + 1] and y[i] >= height:
                found.append((i + j) // 2)
            i = j + 1
        kept = []
        for i in sorted(found, key=lambda k: (y[k], k), reverse=True):
            if all(abs(i - k) >= distance for k in kept):
                kept.append(i)

        def base(side):
            values = [y[i]]
            for v in side:
                if v > y[i]:
                    break
                values.append(v)
            return min(values)

        out = []
        for i in sorted(kept):
            if y[i] - max(base(y[:i][::-1]), base(y[i + 1 :])) >= prominence:
                out.append(i)
        return out

    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 5, 40, 300):
        for y in (r.random(n), np.round(r.random(n), 1), np.zeros(n)):
            for rule in ((0.06, 6, 0.04), (0.5, 1, 0.5), (0.0, 0, 0.0), (0.3, 20, 0.3)):
                assert dsp.local_peaks(y, *rule).tolist() == plain(y.tolist(), *rule), (n, rule)


def test_a_window_is_transformed_once(monkeypatch):
    """Peak and energy of a window come from one spectrum; only the best window's is taken again, for its list of peaks."""
    x, seen, real = np.sin(2 * np.pi * 440 * np.arange(8000) / 8000), [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda v: (seen.append(len(v)), real(v))[1])
    found = dsp.peak_frequency(x, 8000)
    assert len(seen) == len(dsp.windows(8000, 8000)) + 1 and found["peak_frequency_hz"] == 440.0
    assert dsp.dominant(x[:2000], 8000) == dsp.dominant(x[:2000], 8000, np.abs(real(x[:2000])))
    assert dsp.peak_frequency(x[:63], 8000)["peak_frequency_hz"] == 0.0 == dsp.peak_frequency(np.zeros(8000), 8000)["peak_frequency_hz"]
    assert dsp.peak_frequency(np.full(8000, np.nan), 8000)["peaks_hz"] == "0"
