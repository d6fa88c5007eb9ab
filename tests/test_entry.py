"""The registered queries against their SQL statements, at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_entry(spark):
    """The flagship is g3_analyze on these tables, so that one is not run again below."""
    assert entry.entry(spark).first()["rule"] in range(1, 6)


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [q for q in entry.queries() if q != "g3_analyze"])
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF_DIR)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    if name not in entry.oracle_sql():
        assert mine[1]
        return
    result = db.execute(entry.oracle_sql()[name])
    assert mine == canonical([d[0] for d in result.description], result.fetchall())
