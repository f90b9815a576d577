"""Every registered query against its oracle in DuckDB, on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

import lodestar.plans  # noqa: F401
from lodestar import catalog

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else 0.0 if x == 0 else float(f"{x:.12g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def sorted_rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    made = catalog.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in made.collect()]
    if name not in catalog.ORACLES:
        assert made.columns
        return
    found = duck.execute(catalog.ORACLES[name])
    columns = [x[0] for x in found.description]
    assert sorted(made.columns) == sorted(columns)
    assert sorted_rows(made.columns, rows) == sorted_rows(columns, found.fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_pushdown(spark):
    """Filters and columns reach the scan."""
    plan = catalog.QUERIES["filter_range_pruned"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
