"""Every registered query of the engine against the SQL that checks it."""

import math

import duckdb
import pytest

from dynasql.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    sql = registry.oracles().get(name)
    if sql is None:
        assert df.count() > 0
        return
    want = duck.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in order) for r in df.collect()), key=repr)
    theirs = sorted((tuple(norm(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)
    assert mine == theirs
