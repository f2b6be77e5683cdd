"""Versioned tables: writers at once, old versions, conflicts, repeated batches."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from sonolake.sources import versions


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_versions_and_old_reads(spark, tmp_path):
    p = str(tmp_path / "t")
    assert versions.read(spark, p) is None and versions.latest(spark, p) == -1
    assert versions.append(spark.range(3), p) == 0 and versions.append(spark.range(3, 5), p) == 1
    assert versions.replace(spark.range(9, 10), p, read=1) == 2
    assert versions.append(spark.range(10, 11).selectExpr("id", "'x' as more"), p) == 3
    assert [ids(versions.read(spark, p, v)) for v in (0, 1, 2)] == [[0, 1, 2], [0, 1, 2, 3, 4], [9]]
    assert sorted(map(tuple, versions.read(spark, p).collect())) == [(9, None), (10, "x")] and versions.read(spark, p, 7) is None
    assert [tuple(r)[:4] for r in versions.history(spark, p).collect()] == [(0, "append", 1, 3), (1, "append", 2, 2), (2, "replace", 1, 1), (3, "append", 2, 1)]
    assert versions.vacuum(spark, p) == 2 and ids(versions.read(spark, p)) == [9, 10]


def test_writers_at_once(spark, tmp_path):
    p = str(tmp_path / "t")
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda k: versions.append(spark.range(k, k + 1), p), range(6)))
    assert sorted(got) == list(range(6)) and ids(versions.read(spark, p)) == list(range(6))


def test_conflict(spark, tmp_path):
    p = str(tmp_path / "t")
    seen = versions.append(spark.range(2), p)
    versions.append(spark.range(2, 3), p)
    with pytest.raises(versions.Conflict):
        versions.replace(spark.range(1), p, read=seen)
    assert ids(versions.read(spark, p)) == [0, 1, 2]


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    p = str(tmp_path / "t")
    assert [versions.append(spark.range(2), p, token) for token in ("a:0", "a:1", "a:0")] == [0, 1, 0]
    name, n = versions._written(spark.range(2), p)  # two attempts at one batch that both wrote their files
    assert versions.commit(spark, p, "append", lambda _: ([name], []), "a:1", n) == 1 and len(ids(versions.read(spark, p))) == 4


def test_put_if_absent(spark, tmp_path):
    files = versions._Files(spark, str(tmp_path))
    assert files.put_if_absent(f"{tmp_path}/a/x", "1") and not files.put_if_absent(f"{tmp_path}/a/x", "2")
    assert files.read(f"{tmp_path}/a/x") == "1" and [n for n in files.names(f"{tmp_path}/a") if not n.endswith(".crc")] == ["x"]
