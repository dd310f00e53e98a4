"""Registered queries against their SQL on the smallest driver tables, where both exist."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from copyloom import catalog

FOLDER = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def connection():
    from tools.compare import TABLES

    made = duckdb.connect()
    made.sql("SET TimeZone = 'UTC'")
    for table in TABLES:
        made.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return made


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, connection, name):
    from tools.compare import compare

    assert compare(spark, connection, name, str(FOLDER)).startswith("ok")


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["page_id", "url", "domain", "title", "h1", "body_chars"]
    assert rows.count() > 0


def test_every_query_has_sql():
    assert set(catalog.SQL) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())
