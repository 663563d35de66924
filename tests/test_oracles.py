"""Every query with SQL gives what DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from echofield.plans import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    result = duck.execute(ORACLES[name])
    places = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in places) for r in result.fetchall())
    assert len(result.description) == len(columns)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.count() == 10 and "status" in frame.columns


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
