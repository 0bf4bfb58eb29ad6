"""Every registered query of the ledger against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from ledgerspark.plans import registry

DIR = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return f"{type(v).__name__}:{v}"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    cur = duck.execute(SQL[name])
    theirs = [x[0] for x in cur.description]
    assert sorted(theirs) == columns
    want = sorted(tuple(shown(r[theirs.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    df = registry.queries()[name](spark, DIR)
    assert len(df.columns) == len(set(df.columns)) and df.count() > 0
