"""Every registered query against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from marquetry.plans.queries import QUERIES
from marquetry.plans.sql import SQL

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert _rows(df.select(*cols).collect()) == _rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
