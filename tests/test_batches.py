"""Zone batches on small awkward frames."""

from pyspark.sql import functions as F

from sonolake.operators import features
from sonolake.plans import batches


def test_archived_events(spark):
    rows = [("a/raw/x1.wav", " mic ", "t1", "/arch/zz.json"), (None, "m", "t2", "/arch/x2.json"), ("", None, None, "/arch/none.txt"), ("plain", "m", " ", "f")]
    got = {r.uuid: (r.device, r.event_time) for r in batches.archived_events(spark.createDataFrame(rows, "audio_path string, device string, timestamp string, file string")).collect()}
    assert got == {"x1": ("mic", "t1"), "x2": ("m", "t2"), "plain": ("m", None)}


def test_trusted_batch(spark):
    rows = [(" a ", "1", "2024", "p"), ("a", "2", "2025", "p"), ("b", "1", " ", "p"), ("c", "1", "t", " "), (None, "1", "t", "p"), ("d", "1", "t", "p")]
    landing = spark.createDataFrame(rows, "uuid string, source_id string, time_recorded string, audio_path string")
    events = spark.createDataFrame([("b", "old", "1"), ("b", "new", "2")], "uuid string, device string, event_time string")
    done = spark.createDataFrame([(" d ",)], "uuid string")
    got = {r.uuid: (r.source_id, r.time_recorded, r.device) for r in batches.trusted_batch(landing, events, done).collect()}
    assert got == {"a": ("2", "2025", "-"), "b": ("1", "2", "new")}
    assert batches.trusted_batch(landing.limit(0), events.limit(0), None).count() == 0
    assert batches.trusted_batch(landing.drop("audio_path"), events, None).count() == 0


def test_exploitation_batch_keeps_rows_without_a_waveform(spark):
    trusted = spark.createDataFrame([("a", "p", "none", 1.0), ("b", "p", "3", 1.0), ("c", "p", None, 1.0)], "uuid string, audio_path string, peak_frequency_hz string, loudness double")
    waves = spark.createDataFrame([("a", [0.0, 1.0, 0.0, -1.0], 4), ("z", [1.0], 1)], "uuid string, samples array<double>, sample_rate int")
    got = {r.uuid: r for r in batches.exploitation_batch(trusted, waves, None).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].signal_energy == 2.0 and got["a"].harmonic_energy_ratio == 0.0 and got["b"].loudness is None
    assert set(features.FEATURES) <= set(got["a"].asDict())


def test_one_row_for_each_row_whatever_waveforms_there_are(spark):
    trusted = spark.createDataFrame([("a", "p", "2"), ("a", "p", "3"), ("b", "p", None)], "uuid string, audio_path string, peak_frequency_hz string")
    tone = [float(x) for x in (0, 1, 0, -1)]
    waves = spark.createDataFrame([("a", tone, 4), ("a", tone[:3], 4), ("a", tone, 4), ("b", None, 4)], "uuid string, samples array<double>, sample_rate int")
    out = batches.exploitation_batch(trusted, waves, None)
    assert sorted(r.uuid for r in out.collect()) == ["a", "a", "b"]
    done = batches.finished(batches.exploitation_batch(trusted, waves.where("size(samples) = 4"), None)).collect()
    assert [(r.uuid, r.feature_version) for r in done] == [("a", "1.0.0")] * 2 and batches.finished(batches.exploitation_batch(trusted, waves.where("size(samples) = 3"), None)).count() == 0


def test_trusted_batch_from_boundary_names(spark, tmp_path):
    from sonolake.sources import tables

    (tmp_path / "a.csv").write_text("uuid,audio_path,time_recorded/added\nx,a/x.wav,2024\ny,a/y.wav,\n")
    events = spark.createDataFrame([("y", "mic", "2025")], "uuid string, device string, event_time string")
    got = {r.uuid: (r.time_recorded, r.device) for r in batches.trusted_batch(tables.read_csv(spark, str(tmp_path)), events, None).collect()}
    assert got == {"x": ("2024", "-"), "y": ("2025", "mic")}
    bare = spark.createDataFrame([("y", "p")], "uuid string, audio_path string")
    assert [(r.time_recorded, r.device) for r in batches.trusted_batch(bare, events, None).collect()] == [("2025", "mic")]


def test_path_without_a_name_gives_the_archive_file(spark):
    rows = [("a/.wav", "m", "t", "/arch/own.json")]
    got = batches.archived_events(spark.createDataFrame(rows, "audio_path string, device string, timestamp string, file string")).collect()
    assert [r.uuid for r in got] == ["own"]


def test_columns_previews_and_catalogue(spark):
    df = spark.createDataFrame([("b", "0"), ("a", "2.5"), ("c", "nan")], "uuid string, peak_frequency_hz string")
    assert batches.existing(df, "peak_frequency_hz", "other", "uuid").columns == ["peak_frequency_hz", "uuid"]
    assert [r.uuid for r in batches.preview(df, 2, "uuid").collect()] == ["a", "b"]
    assert [r.uuid for r in batches.positive_peak(df).collect()] == ["a"]
    assert df.select(batches.event_id("uuid")).distinct().count() == 3
    full = df.select("uuid", *(F.lit("1").alias(c) for c in ("category", "source", "peak_frequency_hz", "symmetry_score", "pattern_stability_score", "processing_time_seconds", "spectral_entropy", "spectral_centroid_hz")))
    assert set(batches.run_all(full)) == set(batches.CATALOGUE) and batches.run_all(full)["2"].count() == 3
    assert set(batches.CATALOGUE) == set("1234567") and batches.run_all(full)["3"].columns[:2] == ["band", "category"] and "rank" in batches.run_all(full)["1"].columns


def test_keys_and_not_samples_are_shuffled(spark, sf):
    """Where keys are too many for a broadcast, samples that can be made are made behind the last exchange before the features."""
    from sonolake.plans import roundtrips

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for query in (roundtrips.exploitation_batch, roundtrips.exploitation_finished):
            plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
            below = plan[plan.index("MapInPandas") :]
            assert "transform(" in below and "transform(" not in below[below.index("Exchange") :]
        keys = spark.createDataFrame([("a", 4, 1.0), ("b", 4, 2.0), ("b", 4, 1.0)], "uuid string, sample_rate int, own double")
        rows = keys.select("uuid", F.lit("p").alias("audio_path"), F.lit("1").alias("peak_frequency_hz"))
        samples = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.sin(k * F.col("own")))
        made, given = batches.exploitation_batch(rows, keys, None, samples), batches.exploitation_batch(rows, keys.withColumn("samples", samples), None)
        assert sorted(made.collect(), key=repr) == sorted(given.collect(), key=repr) and made.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
