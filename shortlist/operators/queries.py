"""The query side of a search: its size, its terms, its filters.

A query table has ``query_id``, ``text``, and optionally ``vector`` and
``filters`` (see ``schemas.FILTERS``). One measuring job decides whether it is
small enough to be sent to every task at once; larger tables are sent in parts or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.functions.text import terms
from shortlist.schemas import FILTERS
from shortlist.session import MAX_SENT_BYTES

MAX_SENT_QUERIES = 4096


@dataclass(frozen=True)
class Limits:
    """Bounds on what is sent to every task."""

    queries: int = MAX_SENT_QUERIES
    bytes: int = MAX_SENT_BYTES


@dataclass(frozen=True)
class QueryTable:
    """A query table with its measured size; ``unique`` if no ``query_id`` repeats or is NULL."""

    rows: DataFrame
    n: int
    n_filtered: int
    size: int
    small: bool
    unique: bool

    def having(self, rows: DataFrame) -> QueryTable:
        """The same queries with more columns."""
        return replace(self, rows=rows)

    def send(self, df: DataFrame) -> DataFrame:
        """Broadcast a table that is bounded by the queries, if they are few."""
        return F.broadcast(df) if self.small else df


def query_table(queries: DataFrame, limits: Limits = Limits()) -> QueryTable:
    """Complete the columns of a query table and measure it."""
    have = set(queries.columns)
    rows = queries.select(
        "query_id",
        F.coalesce("text", F.lit("")).alias("text") if "text" in have else F.lit("").alias("text"),
        F.col("vector").cast("array<float>").alias("vector")
        if "vector" in have
        else F.lit(None).cast("array<float>").alias("vector"),
        F.col("filters").cast(FILTERS).alias("filters")
        if "filters" in have
        else F.lit(None).cast(FILTERS).alias("filters"),
    )
    parts = ("test_type", "job_level")
    width = (
        F.octet_length("text")
        + 4 * F.coalesce(F.size("vector"), F.lit(0))
        + sum(
            (F.coalesce(F.octet_length(F.array_join(f"filters.{p}", " ")), F.lit(0)) for p in parts),
            F.lit(32),
        )
    )
    n, n_filtered, size, n_ids = rows.agg(
        F.count(F.lit(1)), F.count("filters"), F.coalesce(F.sum(width), F.lit(0)), F.count_distinct("query_id")
    ).first()
    return QueryTable(rows, n, n_filtered, size, n <= limits.queries and size <= limits.bytes, n_ids == n)


def query_terms(rows: DataFrame) -> DataFrame:
    """(query_id, n_terms, term): the distinct terms of each query."""
    found = rows.select("query_id", F.array_distinct(terms(F.col("text"))).alias("terms"))
    return found.select("query_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
