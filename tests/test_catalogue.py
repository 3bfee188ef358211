"""Every registered query with SQL, side by side with DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from docweft.catalogue import files, formats, more, tables, verbs

SF = "/root/testdata/sf0.001"
QUERIES = {**tables.QUERIES, **verbs.QUERIES, **formats.QUERIES, **more.QUERIES, **files.QUERIES}
SQL = {**tables.SQL, **verbs.SQL, **formats.SQL, **more.SQL, **files.SQL}


def tidy(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    return round(v, 5) + 0.0 if isinstance(v, float) else v if isinstance(v, int) else str(v)


def rows(frame):
    return sorted(repr([tidy(v) for v in r]) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
