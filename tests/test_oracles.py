"""Every registered query against its SQL at the smallest size."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
# Checked by brute force in the other tests: no SQL says what they give.
NO_SQL = {"search_vector_kmeans"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if type(value).__name__ == "Decimal" else value


def table(columns, rows):
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(entry.QUERIES) - set(entry.oracle_sql()) == NO_SQL
    assert not set(entry.oracle_sql()) - set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    rows = got.collect()
    if name in NO_SQL:
        assert rows
        return
    cursor = duck.execute(entry.oracle_sql()[name])
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert table(got.columns, rows) == want
