"""Event archive, consumer with dead letters, object copies and moves, enrichment."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolake.operators import enrich
from sonolake.sources import objects, tables, versions
from sonolake.sources.event_archive import EventArchive
from sonolake.streaming import hot


def names(folder):
    return sorted(p for p in os.listdir(folder) if p.endswith(".json") and not p.startswith("."))


def test_archive_after_a_failed_task(spark, tmp_path):
    """A batch whose task fails is not committed; the stream started again archives each event once."""
    spark.dataSource.register(EventArchive)
    spark.range(40).selectExpr("concat('e', id) as uuid", "id as n").repartition(4).write.parquet(f"{tmp_path}/in")
    broken = tmp_path / "broken"
    broken.write_text("")
    marker = str(broken)

    @F.udf("long")
    def risky(n):
        if n == 33 and os.path.exists(marker):
            raise ValueError("a lost task")
        return n

    def run():
        stream = spark.readStream.schema("uuid string, n long").parquet(f"{tmp_path}/in").withColumn("n", risky("n"))
        stream.writeStream.format("event_archive").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="a lost task"):
        run()
    left = names(tmp_path / "out") if (tmp_path / "out").exists() else []
    assert not os.path.exists(tmp_path / "out/_commits") and "e33.json" not in left
    broken.unlink()
    run()
    assert names(tmp_path / "out") == sorted(f"e{i}.json" for i in range(40)) and os.listdir(tmp_path / "out/_attempts") == []
    assert json.loads((tmp_path / "out/e7.json").read_text()) == {"n": 7} and json.loads((tmp_path / "out/_commits/0").read_text())["events"] == 40


def test_archive_of_a_batch_and_an_abort(spark, tmp_path):
    spark.dataSource.register(EventArchive)
    rows = spark.createDataFrame([("a", 1.5, None), (None, 2.0, "é"), (None, 2.0, "é")], "uuid string, x double, device string")
    for _ in range(2):
        rows.write.format("event_archive").mode("append").save(f"{tmp_path}/out")
    assert len(names(tmp_path / "out")) == 2 and json.loads((tmp_path / "out/a.json").read_text()) == {"x": 1.5}
    writer = EventArchive({"path": f"{tmp_path}/out"}).streamWriter(rows.schema, False)
    from pyspark.sql import Row

    told = writer.write(iter([Row(uuid="a", x=1.5), Row(uuid="new", x=3.0)]))
    assert "new.json" in names(tmp_path / "out")
    writer.abort([told, None], 4)
    assert "new.json" not in names(tmp_path / "out") and "a.json" in names(tmp_path / "out")


def test_consumer(spark, tmp_path):
    (tmp_path / "o/b/raw").mkdir(parents=True)
    for name in ("1", "2"):
        (tmp_path / f"o/b/raw/{name}.wav").write_bytes(b"x")

    def drop(name, *events):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.json").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events))

    def event(name, time, bucket="b"):
        return {"audio_path": f"raw/{name}.wav", "bucket": bucket, "timestamp": time}

    def run(mark):
        hot.consume(hot.json_events(spark, f"{tmp_path}/in"), f"{tmp_path}/o", f"{tmp_path}/t", f"{tmp_path}/{mark}")
        return sorted(((r.audio_path, r.timestamp, r.reason) for r in versions.read(spark, f"{tmp_path}/t").collect()), key=repr)

    drop("a", event("1", "t2"), event("1", "t1"), event("9", "t1"), "no json", {"bucket": "b"}, event("2", "t0", ""))
    first = run("m")
    assert first == sorted([("raw/1.wav", "t1", None), ("raw/9.wav", "t1", "no object"), (None, None, "no audio_path or bucket"), (None, None, "no audio_path or bucket"), ("raw/2.wav", "t0", "no audio_path or bucket")], key=repr)
    drop("b", event("2", "t5"), event("1", "t7"))
    second = run("m")
    assert second == sorted([*first, ("raw/2.wav", "t5", None)], key=repr)
    assert run("m") == second and run("from the start") == second


def test_copies_and_moves(spark, tmp_path):
    (tmp_path / "a").mkdir()
    tone = tables.encode_wav(np.sin(np.arange(4000) / 3), 8000)
    for name, data in (("big", os.urandom(3_000_000)), ("tone", tone), ("other", b"text")):
        (tmp_path / f"a/{name}").write_bytes(data)
    plan = spark.createDataFrame([(f"file://{tmp_path}/a/{n}", f"{tmp_path}/b/x/{n}") for n in ("big", "tone", "other", "none")], "source string, target string")

    def refused(source, target):
        raise OSError("not allowed")

    first = {r.source.rsplit("/", 1)[1]: r for r in objects.copy_objects(plan, f"{tmp_path}/m", copier=refused).collect()}
    assert {k: r.status for k, r in first.items()} == {"big": "failed", "tone": "re-encoded", "other": "failed", "none": "failed"}
    assert np.allclose(tables.decode_wav((tmp_path / "b/x/tone").read_bytes())[1], tables.decode_wav(tone)[1], atol=1e-3)
    second = {r.source.rsplit("/", 1)[1]: r for r in objects.copy_objects(plan, f"{tmp_path}/m", move=True).collect()}
    assert {k: r.status for k, r in second.items()} == {"big": "copied", "tone": "re-encoded", "other": "copied", "none": "missing"}
    assert os.listdir(tmp_path / "a") == [] and (second["big"].size, second["big"].sha256) == objects.digest(f"{tmp_path}/b/x/big")
    third = {r.source.rsplit("/", 1)[1]: r.status for r in objects.copy_objects(plan, f"{tmp_path}/m", move=True).collect()}
    assert third == {k: r.status for k, r in second.items()} and sorted(os.listdir(tmp_path / "b/x")) == ["big", "other", "tone"]


def test_enrichment(spark, tmp_path):
    t = np.arange(8000) / 8000
    waves = {"tone": np.sin(2 * np.pi * 440 * t), "short": np.sin(2 * np.pi * 440 * t[:7999]), "silent": np.zeros(8000)}
    made = spark.createDataFrame([(f"{k}.wav", bytearray(tables.encode_wav(x, 8000))) for k, x in waves.items()] + [("bad.wav", bytearray(b"RIFF"))], "name string, content binary")
    assert objects.write_objects(made, f"{tmp_path}/l").count() == 4
    rows = spark.createDataFrame([("1", " tone.wav", "x"), ("2", "short.wav", "x"), ("3", "silent.wav", "x"), ("4", "bad.wav", "x"), ("5", "gone.wav", "x"), ("6", None, "x"), ("7", " ", "x")], "uuid string, audio_path string, duration string")
    good, bad = enrich.to_trusted(rows, f"{tmp_path}/l", f"{tmp_path}/t", f"{tmp_path}/m")
    one = good.collect()
    assert len(one) == 1 and (one[0].audio_path, one[0].peak_frequency_hz, one[0].duration, one[0].processing_version) == ("audio/440/1-440.wav", 440.0, 1.0, "2.0.0")
    assert one[0].audio_size == 16044 and (tmp_path / "t/audio/440/1-440.wav").read_bytes() == (tmp_path / "l/tone.wav").read_bytes()
    assert {r.uuid: r.reason for r in bad.collect()} == {"2": "too short", "3": "no frequency", "4": "does not decode", "5": "no object", "6": "no audio_path", "7": "no audio_path"}
    assert objects.listing(spark, f"{tmp_path}/none").count() == 0


def test_lengths_of_objects(spark, tmp_path):
    """What is there is asked object by object; names that a folder's list would not have are not there."""
    (tmp_path / "a b/c").mkdir(parents=True)
    (tmp_path / "a b/c/x é.wav").write_bytes(b"123")
    (tmp_path / "a b/empty").write_bytes(b"")
    names = ["c/x é.wav", "empty", "c", "none", "c//x é.wav", "../a b/empty", "./empty", "empty/x", "n" * 300, "", None]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.n for r in rows.select("name", objects.length_of(F.col("name"), f"{tmp_path}/a b").alias("n")).collect()}
    assert {k: v for k, v in got.items() if v is not None} == {"c/x é.wav": 3, "empty": 0} and len(got) == len(names)
    whole = rows.limit(1).select(objects.length_of(F.lit(f"{tmp_path}/a b/empty")).alias("a"), objects.length_of(F.lit("no uri at all")).alias("b")).first()
    assert (whole.a, whole.b) == (0, None)


def test_objects_are_put_and_copied_by_all_tasks(spark, tmp_path):
    """Small rows of one partition are dealt to all tasks, which put, copy and report; no job lists the folders file by file."""
    rows = spark.range(2000).select(F.col("id").cast("string").alias("name")).coalesce(1)
    put = objects.write_objects(rows, f"{tmp_path}/a", lambda r: None if r["name"] == "7" else r["name"].encode())
    assert put.count() == 1999 and put.agg(F.sum("size")).first()[0] == sum(len(str(i)) for i in range(2000) if i != 7)
    tasks = 4 * spark.sparkContext.defaultParallelism
    assert len([p for p in put.inputFiles()]) > tasks // 2
    plan = rows.select(F.concat(F.lit(f"{tmp_path}/a/"), "name").alias("source"), F.concat(F.lit(f"{tmp_path}/b/"), "name").alias("target"))
    for _ in range(2):
        report = objects.copy_objects(plan, f"{tmp_path}/m", move=True)
    assert len(versions.read(spark, f"{tmp_path}/m").inputFiles()) > tasks // 2
    assert {(r.status, r["count"]) for r in report.groupBy("status").count().collect()} == {("copied", 1999), ("missing", 1)} and os.listdir(tmp_path / "a") == []


def test_a_move_names_the_same_bytes_anew(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x").write_bytes(b"one")
    (tmp_path / "real").write_bytes(b"far")
    (tmp_path / "a/link").symlink_to(tmp_path / "real")
    inode = (tmp_path / "a/x").stat().st_ino
    for _ in range(2):  # again, as after a run that failed before its commit
        objects.rename_later(f"{tmp_path}/a/x", f"file://{tmp_path}/b/x")
    assert os.listdir(tmp_path / "b") == ["x"] and (tmp_path / "b/x").stat().st_ino == inode
    plan = spark.createDataFrame([(f"{tmp_path}/a/{n}", f"{tmp_path}/b/{n}") for n in ("x", "link")], "source string, target string")
    assert {r.status for r in objects.copy_objects(plan, f"{tmp_path}/m", move=True).collect()} == {"copied"} and os.listdir(tmp_path / "a") == []
    assert (tmp_path / "b/x").read_bytes() == b"one" and (tmp_path / "b/link").read_bytes() == b"far" and not (tmp_path / "b/link").is_symlink() and (tmp_path / "real").exists()
    objects.copy(f"{tmp_path}/b/x", f"{tmp_path}/c/x")
    assert (tmp_path / "c/x").stat().st_ino != inode


def test_a_second_name_is_read_once(tmp_path, monkeypatch):
    """Bytes that only got a second name are not hashed twice; a copy is still compared, and one that differs is not kept as such."""
    (tmp_path / "x").write_bytes(b"one")
    read, real = [], objects.digest
    monkeypatch.setattr(objects, "digest", lambda uri: (read.append(uri), real(uri))[1])
    one = real(f"{tmp_path}/x")
    for _ in range(2):  # again, as after a run that failed before its commit
        assert objects._copied(f"{tmp_path}/x", f"{tmp_path}/m/n/x", objects.rename_later) == (*one, "copied", None)
    assert read == [f"{tmp_path}/m/n/x"] * 2
    assert objects._copied(f"{tmp_path}/x", f"{tmp_path}/c/x", objects.copy) == (*one, "copied", None) and read[2:] == [f"{tmp_path}/c/x", f"{tmp_path}/x"]

    def wrong(source, target):
        objects.put(target, b"two")

    assert objects._copied(f"{tmp_path}/x", f"{tmp_path}/c/y", wrong)[2] == "failed"
    assert objects._copied(f"{tmp_path}/none", f"{tmp_path}/c/z", objects.rename_later)[2] == "missing" and not (tmp_path / "c/z").exists()


def test_drafts_lie_apart_and_hashes_stay_where_they_are(spark, tmp_path, monkeypatch):
    """A task's drafts are not entries of the folder that all tasks put into; the deletion of sources reads no hashes; odd rows as before."""
    from pyspark.sql.dataframe import DataFrame

    with objects.drafts(f"{tmp_path}/a") as own:
        monkeypatch.setattr(objects, "_draft", None)
        for data in (b"1", b"22"):
            objects.put(f"{tmp_path}/a/deep/er/x", data, own)
        monkeypatch.undo()
        assert (tmp_path / "a/deep/er/x").read_bytes() == b"22" and os.listdir(tmp_path / "a/deep/er") == ["x"]
    rows = spark.createDataFrame([("n1", b"1"), ("n1", b"1"), ("s/n2", b""), (None, b"3"), ("n4", None), ("é 5%20", b"5")], "name string, content binary")
    put = objects.write_objects(rows, f"{tmp_path}/a")
    assert sorted((r.name, r.size) for r in put.collect()) == [("n1", 1), ("n1", 1), ("s/n2", 0), ("é 5%20", 1)] and os.listdir(tmp_path / "a.drafts") == []
    plans, real = [], type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *a, **b: (plans.append((schema, self._jdf.queryExecution().executedPlan().toString())), real(self, f, schema, *a, **b))[1])
    plan = spark.createDataFrame([(f"{tmp_path}/a/{n}", None if t is None else f"{tmp_path}/b/{t}") for n, t in (("n1", "n1"), ("n1", "n1"), ("n1", "again"), ("s/n2", "n2"), ("none", "x"), ("n4", None))] + [(None, f"{tmp_path}/b/y")], "source string, target string")
    for _ in range(2):
        report = objects.copy_objects(plan, f"{tmp_path}/m", move=True)
    assert isinstance(report, DataFrame) and sorted((r.target.rsplit("/", 1)[1], r.size, r.status) for r in report.collect()) == [("again", 1, "copied"), ("n1", 1, "copied"), ("n2", 0, "copied"), ("x", None, "missing")]
    assert not (tmp_path / "a/n1").exists() and sorted(os.listdir(tmp_path / "b")) == ["again", "n1", "n2"]
    removals = [p for schema, p in plans if "gone" in schema]
    assert len(removals) == 2 and all("status" in p and "sha256" not in p for p in removals)


def test_objects_are_made_one_at_a_time_and_heard_once(spark, sf, tmp_path):
    """No column of samples or bytes goes to or from Python for what a task can make; rejected rows don't read the objects again."""
    import shutil

    from sonolake.plans import hotpath

    seen = []
    real = objects.write_objects
    objects.write_objects = lambda rows, *a: (seen.append(rows.columns), real(rows, *a))[1]
    try:
        hotpath.trusted_enrichment(spark, sf)
    finally:
        objects.write_objects = real
    assert seen == [["name", "vec_id"]]
    assert len(tables.decode_wav(hotpath.sound({"vec_id": 13}))[1]) == 4000 and hotpath.sound({"vec_id": 9}) == b"no sound" and not tables.decode_wav(hotpath.sound({"vec_id": 5}))[1].any()
    made = spark.createDataFrame([("tone.wav", bytearray(hotpath.sound({"vec_id": 0}))), ("bad.wav", bytearray(b"RIFF"))], "name string, content binary")
    objects.write_objects(made, f"{tmp_path}/l")
    rows = spark.createDataFrame([("1", "tone.wav"), ("2", "bad.wav"), ("3", "gone.wav")], "uuid string, audio_path string")
    good, bad = enrich.to_trusted(rows, f"{tmp_path}/l", f"{tmp_path}/t", f"{tmp_path}/m")
    shutil.rmtree(tmp_path / "l")
    assert {r.uuid: r.reason for r in bad.collect()} == {"2": "does not decode", "3": "no object"} and [r.uuid for r in good.collect()] == ["1"]


def test_archived_events_have_no_drafts_among_them(tmp_path, monkeypatch):
    """A task's events are drafted in a folder of its own, which goes with the task; its list alone is drafted where it lies."""
    from pyspark.sql import Row

    drafted, real = [], objects._draft
    monkeypatch.setattr(objects, "_draft", lambda path: (drafted.append(path), real(path))[1])
    writer = EventArchive({"path": f"{tmp_path}/out"}).writer(None, False)
    told = writer.write(iter([Row(uuid=u, x=1.5) for u in ("a", "b", "a", None)]))
    assert len(drafted) == 1 and "_attempts" in drafted[0] and len(names(tmp_path / "out")) == 3 and os.listdir(tmp_path / "out.drafts") == []
    assert told.n == 4 and [json.loads(x)["new"] for x in objects.get(told.listed).decode().split("\n")] == [True, True, False, True]


def test_archive_read_by_its_lists(spark, tmp_path):
    """Readers take names from the lists of committed batches: no listing of objects, repeated events once, given-up ones not at all."""
    from pyspark.sql import Row

    from sonolake.sources.event_archive import archived, archived_stream

    spark.dataSource.register(EventArchive)
    root = f"{tmp_path}/out"
    assert archived(spark, root).count() == 0
    rows = spark.range(300).selectExpr("concat('e', id) as uuid", "concat('raw/e', id, '.wav') as audio_path", "'b' as bucket", "lpad(id, 12, '0') as timestamp")
    for part in (rows, rows.where("timestamp < '000000000100'")):
        part.write.format("event_archive").mode("append").save(root)
    writer = EventArchive({"path": root}).streamWriter(rows.schema, False)
    writer.abort([writer.write(iter([Row(uuid="late", audio_path="p", bucket="b", timestamp="t")]))], 4)
    found = archived(spark, root)
    assert len(found.inputFiles()) <= 16 and found.count() == 300  # lists, and not a file for each event
    assert {(r.audio_path, r.timestamp, r.file.rsplit("/", 1)[1]) for r in found.where("bucket = 'b'").collect()} == {(f"raw/e{i}.wav", f"{i:012d}", f"e{i}.json") for i in range(300)}
    (tmp_path / "z/b/raw").mkdir(parents=True)
    for i in range(0, 300, 2):
        (tmp_path / f"z/b/raw/e{i}.wav").write_bytes(b"x")
    hot.consume(archived_stream(spark, root).drop("file"), f"{tmp_path}/z", f"{tmp_path}/t", f"{tmp_path}/mark")
    assert {(r.reason, r["count"]) for r in versions.read(spark, f"{tmp_path}/t").groupBy("reason").count().collect()} == {(None, 150), ("no object", 150)}
