"""Registered pipeline queries against their SQL."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from test_oracles import plain, table  # noqa: E402,F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.LLM_ORACLES))
def test_query(spark, name):
    duck = duckdb.connect()
    for file in os.listdir(SF):
        duck.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    cursor = duck.execute(entry.oracle_sql()[name])
    assert table(got.columns, rows) == table([c[0] for c in cursor.description], cursor.fetchall())
