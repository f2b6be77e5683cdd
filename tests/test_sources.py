"""Readers, writers, the paged source and the image scores."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolake.functions import images
from sonolake.sources import paged, tables


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('uuid,text\n1,"two\nlines, ""quoted"""\n2,\n3,""\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", 'two\nlines, "quoted"'), ("2", None), ("3", None)]


def test_missing_inputs_are_empty(spark, tmp_path):
    assert tables.read_events(spark, f"{tmp_path}/none/*.json").count() == 0
    assert tables.read_parquet(spark, f"{tmp_path}/none") is None
    assert tables.inspect(spark, f"{tmp_path}/none")["status"] == "missing_bucket"
    assert tables.inspect(spark, str(tmp_path))["status"] == "no_table"


def test_incremental_ingest(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "source_id string, created string")
    target, mark = f"{tmp_path}/t", f"{tmp_path}/mark"
    assert tables.read_checkpoint(spark, mark) is None
    first = rows(("1", "2024-01-01"), ("1", "2024-01-01"), ("2", "2024-01-03"))
    tables.ingest_since(first, "created", "source_id", target, mark, "2024-01-02")
    tables.ingest_since(first.union(rows(("3", "2024-01-02"), ("0", "2023-12-01"))), "created", "source_id", target, mark, "2024-01-05")
    assert sorted(r.source_id for r in spark.read.parquet(target).collect()) == ["1", "2", "3"]
    tables.ingest_since(first.limit(0), "created", "source_id", target, mark, "2024-01-09")
    assert tables.read_checkpoint(spark, mark) == "2024-01-09" and spark.read.parquet(target).count() == 3


def test_events(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"audio_path": "a/x.wav", "bucket": "b", "duration": 5}))
    r = tables.read_events(spark, str(tmp_path)).first()
    assert (r.audio_path, r.duration, r.device) == ("a/x.wav", 5, None) and r.file.endswith("e.json")


def test_append_unites_columns(spark, tmp_path):
    p = f"{tmp_path}/t"
    tables.append(spark.createDataFrame([("1",)], "uuid string"), p)
    tables.append(spark.createDataFrame([("2", "rain")], "uuid string, category string"), p)
    assert sorted(map(tuple, tables.read_parquet(spark, p).collect())) == [("1", None), ("2", "rain")]
    out = tables.append_text(spark.createDataFrame([("3", 1.5)], "uuid string, x double"), spark, p)
    assert sorted(tuple(r[c] for c in ("uuid", "category", "x")) for r in out.collect()) == [("1", "", ""), ("2", "rain", ""), ("3", "", "1.5")]


def test_snapshots(spark, tmp_path):
    p = f"{tmp_path}/zone/snapshots"
    assert tables.sync_snapshot(spark, f"{tmp_path}/none", p) is None
    assert [tables.write_snapshot(spark.range(n), p) for n in (2, 3)] == [0, 1]
    df, version = tables.read_snapshot(spark, p)
    assert (df.count(), version) == (3, 1)
    assert tables.inspect(spark, f"{tmp_path}/zone") == {"status": "ok", "version": 1, "rows": 3, "cols": 1, "columns": ["id"]}


def test_export_csv(spark, tmp_path):
    tables.export_csv(spark.createDataFrame([(1, "a,b")], "x int, uuid string"), f"{tmp_path}/c", ("uuid",))
    tables.export_csv(spark.createDataFrame([("c", 2), ("d", 3)], "name string, uuid int"), f"{tmp_path}/c", ("uuid",))
    out = tables.read_exports(spark, f"{tmp_path}/c")
    assert sorted((r.uuid, r.x, r.name) for r in out.collect()) == [("2", None, "c"), ("3", None, "d"), ("a,b", "1", None)] and tables.read_exports(spark, f"{tmp_path}/none") is None


def test_waves(spark, tmp_path):
    x = np.sin(np.arange(100) / 5)
    (tmp_path / "a.wav").write_bytes(tables.encode_wav(x, 8000))
    (tmp_path / "b.wav").write_bytes(b"no")
    got = {r.path[-5:]: r for r in tables.read_waves(spark, str(tmp_path)).collect()}
    assert got["a.wav"].sample_rate == 8000 and np.allclose(got["a.wav"].samples, x, atol=1e-3)
    assert got["b.wav"].samples is None


def test_retries():
    told, slept = iter([(429, b""), (503, b""), (200, b'{"results": [1]}')]), []
    assert paged.fetch("u", lambda _: next(told), slept.append) == {"results": [1]}
    assert slept == [30.0, 4.0] and paged.wait_before(9, 502) == 60
    with pytest.raises(RuntimeError):
        paged.fetch("u", lambda _: (404, b""), slept.append)
    with pytest.raises(ValueError):
        paged.fetch("u", lambda _: (200, b"[]"), slept.append)


def test_paged_source(spark):
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"results": [{"id": len(asked), "name": "n", "created": "2024", "duration": 2, "tags": ["a", "b"], "description": "x\ny"}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    paged.register(spark)
    df = spark.read.format("sound_search").option("url", f"http://127.0.0.1:{server.server_port}/s").option("queries", "rain,wind").option("pages", 2).option("created_after", "2024-01-01").load()
    rows = df.collect()
    server.shutdown()
    assert len(rows) == 4 and {r.query for r in rows} == {"rain", "wind"} and rows[0].tags == "a|b" and rows[0].description == "x y"
    assert all("created" in p for p in asked)


def test_ingest_takes_new_ids_once(spark):
    found = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "source_id string")
    assert sorted(r[0] for r in paged.new_only(found, found.where(F.col("source_id") == "3")).collect()) == ["1", "2"]
    assert [r[0] for r in paged.drawn(found, "source_id", 2, 7).collect()] == [r[0] for r in paged.drawn(found.repartition(3), "source_id", 2, 7).collect()]


def test_image_scores():
    axis = np.linspace(-1, 1, 65)
    field = np.cos(9 * np.hypot(*np.meshgrid(axis, axis)))
    assert images.symmetry_score(field) > 0.9 and images.symmetry_score(np.full((5, 5), 7)) == 0.5
    assert images.symmetry_score(np.arange(64).reshape(8, 8) % 8) < 0.1
    assert images.pattern_stability([field]) == 1.0 and abs(images.pattern_stability([field] * 7) - 1) < 1e-9
