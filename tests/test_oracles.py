"""Every registered query against its SQL on DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.queries()))
def test_query(spark, con, sf_dir, key):
    note, _, good = compare(spark, con, sf_dir, key, entry.queries()[key], entry.oracle_sql().get(key))
    assert good, note


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
