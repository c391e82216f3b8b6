"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import queries as library

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for n in NAMES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def plain(v):
    if isinstance(v, float) and math.isnan(v) or v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_same_rows(spark, duck, name):
    df = library.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(library.SQL[name])
    at = [d[0] for d in cursor.description]
    assert sorted(at) == columns
    theirs = sorted(tuple(plain(r[at.index(c)]) for c in columns) for r in cursor.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.SQL)))
def test_runs(spark, name):
    assert library.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
