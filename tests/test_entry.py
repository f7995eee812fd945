"""All registered queries against DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tessellum import catalog, catalog_rules

DATA = Path("/root/testdata/sf0.001")
QUERIES = catalog.QUERIES | catalog_rules.QUERIES
ORACLES = catalog.ORACLES | catalog_rules.ORACLES
needs_data = pytest.mark.skipif(not DATA.is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _value(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else repr(v)


@needs_data
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(_value(r[c]) for c in columns) for r in df.collect())
    made = duck.sql(ORACLES[name])
    at = [made.columns.index(c) for c in columns]
    assert sorted(made.columns) == columns
    assert got == sorted(tuple(_value(r[i]) for i in at) for r in made.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(QUERIES) == set(ORACLES)
