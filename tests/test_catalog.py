"""Every query against its SQL twin in DuckDB, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tallyloom.plans import catalog


def rounded(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(rounded, v)) if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr(rounded(tuple(r[c] for c in columns))) for r in df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name not in catalog.ORACLE_SQL:
        return
    got = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(rounded(tuple(r[i] for i in at))) for r in got.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
