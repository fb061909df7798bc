"""Every query with a SQL twin gives the same rows as DuckDB on the same files."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
ORACLES = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, duck, name):
    df = entry_points.queries()[name](spark, sf)
    columns = sorted(df.columns)
    ours = _sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = _sorted(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    assert ours == theirs


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0 and "fold" in df.columns
