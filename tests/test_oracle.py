"""Every registered query against its DuckDB SQL on the smallest tables."""

import glob
import math

import pytest

from sonolake.plans.registry import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {p.rsplit('/', 1)[1][:-8]} as select * from '{p}'")
    return con


def _plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLE:
        assert rows
        return
    cursor = duck.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(_plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(_plain(r[c]) for c in order) for r in rows), key=repr) == want
