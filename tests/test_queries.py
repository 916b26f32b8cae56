"""Every registered query against its SQL on the smallest data."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from tests.conftest import SMALL

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        if Path(f"{SMALL}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns, got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        assert columns
        return
    result = db.execute(ORACLES[name])
    expected_columns, expected = rows_of([d[0] for d in result.description], result.fetchall())
    assert columns == expected_columns
    assert got == expected


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and rows[0]["tokens"] >= rows[-1]["tokens"]
