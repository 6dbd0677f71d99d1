"""Every query with SQL against DuckDB on the smallest tables, and every other one run to its end."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from orrery.plans import problems, reference

QUERIES = reference.QUERIES | problems.QUERIES
SQL = reference.SQL | problems.SQL


@pytest.fixture(scope="module")
def con(base):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{base}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return c


def canon(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return ""
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.9g}"
        return str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(one(v) for v in r) for r in df.itertuples(index=False, name=None))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, base, con, name):
    got = QUERIES[name](spark, base).toPandas()
    if name in SQL:
        want = con.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
