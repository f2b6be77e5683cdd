"""ZIP archives, upserts, the stream of latest events, downloads with fall-backs and retries."""

import random
import zipfile

import pytest
from pyspark.errors import StreamingQueryException

from sonolake.operators import zones
from sonolake.sources import archive, paged, versions
from sonolake.streaming import hot


def test_zip_entries(spark, tmp_path):
    data = {f"set/audio/{i}.wav": random.Random(i).randbytes(5_000) + b"0" * 5_000 for i in range(9)} | {"set/notes.txt": b"n", "set/empty.wav": b""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.comment = b"a comment"
        for k, (name, body) in enumerate(data.items()):
            z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
        z.mkdir("set/folder")
    uri = f"file://{tmp_path}/a.zip"
    assert {r.entry: bytes(r.content) for r in archive.entries(spark, [uri]).collect()} == data
    assert {r.entry for r in archive.entries(spark, [uri], "*.txt").collect()} == {"set/notes.txt"}
    parts = archive.planned(uri, "*.wav", 12_000)
    assert len(parts) > 3 and [e[0] for p in parts for e in p.entries] == [n for n in data if n.endswith(".wav")]
    body = bytearray((tmp_path / "a.zip").read_bytes())
    body[200] ^= 1
    (tmp_path / "a.zip").write_bytes(body)
    with pytest.raises(Exception, match="damaged"):
        archive.entries(spark, [uri]).collect()


def test_dataset_by_its_index(spark, tmp_path):
    for k in (1, 2):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr("d/meta/i.csv", f'filename,fold,target,category\r\na.wav,{k},0,dog\r\nb.wav,1,1,"rain, soft"\r\nnone.wav,1,1,dog\r\n')
            z.writestr("d/audio/a.wav", f"a{k}")
            z.writestr("d/audio/b.wav", f"b{k}")
            z.writestr("d/audio/c.wav", "not in the index")
    found = archive.dataset(spark, [f"{tmp_path}/1.zip", f"{tmp_path}/2.zip"]).collect()
    assert sorted((r.filename, r.fold, r.category, bytes(r.content)) for r in found) == [("a.wav", 1, "dog", b"a1"), ("a.wav", 2, "dog", b"a2"), ("b.wav", 1, "rain, soft", b"b1"), ("b.wav", 1, "rain, soft", b"b2")]
    assert archive.dataset(spark, [f"{tmp_path}/1.zip"], categories=["dog"]).count() == 1


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    p = str(tmp_path / "t")
    merge = lambda old, new: new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new)
    put = lambda rows, token=None: versions.upsert(spark.createDataFrame(rows, "k int, v string"), p, "k", merge, 8, token)
    assert put([(i, "a") for i in range(50)]) == 0
    before = set(versions.folders(versions.log(spark, p)))
    assert put([(3, "b"), (99, "b")], "one") == 1 and put([(3, "c")], "one") == 1
    after = set(versions.folders(versions.log(spark, p)))
    assert len(before - after) <= 2 and len(before & after) >= len(before) - 2
    assert {r.k: r.v for r in versions.read(spark, p).collect()} == {i: "a" for i in range(50)} | {3: "b", 99: "b"}
    assert {r.v for r in versions.read(spark, p, 0).collect()} == {"a"}

    def raced(old, new):
        put([(3, "other")])
        return merge(old, new)

    with pytest.raises(versions.Conflict):
        versions.upsert(spark.createDataFrame([(3, "late")], "k int, v string"), p, "k", raced, 8)
    versions.vacuum(spark, p)
    assert {r.v for r in versions.read(spark, p).where("k = 3").collect()} == {"other"} and versions.read(spark, p).count() == 51


def test_latest_events_equal_the_batch_merge_after_each_batch(spark, tmp_path):
    rnd, schema = random.Random(5), "uuid string, device string, event_time string"
    rows = spark.createDataFrame([(f"u{i}",) for i in range(12)], "uuid string")
    seen = []
    for k in range(3):
        new = [(rnd.choice([*(f"u{i}" for i in range(9)), None, ""]), rnd.choice("abc"), rnd.choice([None, *(str(t) for t in range(9))])) for _ in range(25)]
        seen += new
        spark.createDataFrame(new, schema).write.mode("append").parquet(f"{tmp_path}/in")
        hot.merge_latest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/m")
        every = zones.latest(spark.createDataFrame([r for r in seen if r[0]], schema), ["uuid"], "event_time", "device")
        out = [sorted(map(tuple, zones.merge_events(rows, e).collect())) for e in (versions.read(spark, f"{tmp_path}/t"), every)]
        assert out[0] == out[1]


def test_downloads_fall_back(spark):
    there = {"orig": (200, b"o" * 200), "small": (200, b"x"), "hq": (200, b"h" * 200), "lq": (200, b"l" * 200), "gone": (404, b"")}
    get = lambda url: there[url]
    both = {"preview-hq-mp3": "hq", "preview-lq-mp3": "lq"}
    slept = []
    assert paged.sound_bytes("orig", "flac", both, get) == (b"o" * 200, "flac") and paged.sound_bytes("small", None, both, get) == (b"h" * 200, "mp3")
    assert paged.sound_bytes("gone", "wav", {"preview-lq-mp3": "lq"}, get) == (b"l" * 200, "mp3")
    assert paged.sound_bytes(None, None, None, get) is None and paged.sound_bytes("gone", None, {}, get) is None
    told = iter([(429, b""), (503, b""), (200, b"z" * 200)])
    assert paged.sound_bytes("any", None, None, lambda _: next(told), slept.append) == (b"z" * 200, "wav") and slept == [30.0, 4.0]
    rows = spark.createDataFrame([("1", "orig", "wav", None), ("2", None, None, both), ("3", "gone", "wav", None)], "id string, download string, type string, previews map<string,string>")
    assert sorted((r.id, None if r.content is None else bytes(r.content[:1]), r.ending) for r in paged.download(rows, get).collect()) == [("1", b"o", "wav"), ("2", b"h", "mp3"), ("3", None, None)]


def test_retries_of_a_stream():
    tries, slept = [], []

    def run():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError("not ready") if len(tries) == 1 else StreamingQueryException("lost")

    assert hot.with_retries(run, sleep=slept.append) == 3 and slept == [3.0, 3.0]
    with pytest.raises(ConnectionError):
        hot.with_retries(lambda: (_ for _ in ()).throw(ConnectionError()), sleep=slept.append)
    assert len(slept) == 6
