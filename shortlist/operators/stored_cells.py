"""Approximate search over items stored by cell.

The items lie in a table partitioned by cell. A search joins it with the cells that its
queries probe, so Spark reads the files of those cells only (dynamic partition pruning);
they stay where they are, and a batch of a cell meets the queries that probe it. A hot
cell has many files, which are split by size when they are written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.constants import DEFAULT_TOP_K
from shortlist.operators.blocks import (
    ITEM_COLUMNS,
    QUERY_COLUMNS,
    QueryBlock,
    Scoring,
    best_rows,
    candidates_schema,
    key_types,
    score_block,
    to_arrow,
)
from shortlist.operators.filters import numbered
from shortlist.operators.lexical import ranked
from shortlist.operators.queries import Limits, query_table
from shortlist.operators.vector_search import probed_cells, search_cells
from shortlist.session import MAX_SENT_BYTES, delete_folder, shared_folder

_ROWS_PENDING = 500_000


@dataclass(frozen=True)
class StoredCells:
    """``items``: the columns of an index and ``cell``; ``centroids``: id (the cell), embedding."""

    items: DataFrame
    centroids: DataFrame


def store_cells(items: DataFrame, centroids: DataFrame, name: str | None = None) -> StoredCells:
    """Store items with a ``cell`` in the shared folder, as table ``<name>_items`` by cell.

    Items without a vector are left out, as no search finds them.
    """
    spark = items.sparkSession
    name = name or f"cells_{uuid.uuid4().hex}"
    known = items.where(F.col("embedding").isNotNull()).hint("rebalance", "cell")
    for part, rows in (("items", known), ("centroids", centroids)):
        writer = rows.write.mode("overwrite").option("path", f"{shared_folder(spark)}/{name}/{part}")
        (writer.partitionBy("cell") if part == "items" else writer).saveAsTable(f"{name}_{part}")
    return open_cells(spark, name)


def open_cells(spark: SparkSession, name: str) -> StoredCells:
    """Stored cells."""
    return StoredCells(spark.table(f"{name}_items"), spark.table(f"{name}_centroids"))


def drop_cells(spark: SparkSession, name: str) -> None:
    """Forget stored cells and delete their files."""
    for part in ("items", "centroids"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
    delete_folder(spark, f"{shared_folder(spark)}/{name}")


def probed_items(cells: StoredCells, probes: DataFrame) -> DataFrame:
    """Items of the probed cells; other cells are not read.

    The comparison always holds; Spark prunes partitions only for a filtered side. There
    are never more cells than centroids.
    """
    asked = probes.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    return cells.items.join(F.broadcast(asked), "cell", "left_semi")


def search_stored_cells(
    queries: DataFrame, cells: StoredCells, n_probe: int, k: int = DEFAULT_TOP_K, limits: Limits = Limits()
) -> DataFrame:
    """(query_id, rank, id, cosine_score): as ``search_cells``, reading only probed cells.

    A query table that is too large to be sent takes the way of ``search_cells``: it
    probes about every cell anyway.
    """
    table = query_table(queries, limits)
    probes = probed_cells(queries, cells.centroids, n_probe, limits)
    # The vectors go along once for each probe.
    if not table.small or table.size * n_probe > MAX_SENT_BYTES:
        return search_cells(queries, cells.items, cells.centroids, n_probe, k, limits)
    marked, table = numbered(probed_items(cells, probes), table)
    asked = probes.join(table.rows, "query_id").select("cell", *QUERY_COLUMNS)
    sent = queries.sparkSession.sparkContext.broadcast(asked.toArrow())
    how = Scoring(k=k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, size, keys = [], 0, {}
        cell, block = None, None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            keys = key_types(part, sent.value)
            # Files belong to one cell, so a batch has one or two.
            for here in pc.unique(part["cell"]):
                if cell is None or here != cell:
                    cell, block = here, QueryBlock.of(sent.value.filter(pc.equal(sent.value["cell"], here)))
                pending.append(score_block(part.filter(pc.equal(part["cell"], here)), block, how))
                size += len(pending[-1])
            if size > _ROWS_PENDING:
                pending = [best_rows(pd.concat(pending, ignore_index=True), k)]
                size = 0
        if pending:
            yield from to_arrow(best_rows(pd.concat(pending, ignore_index=True), k), keys).to_batches()

    rows = marked.select("cell", *ITEM_COLUMNS).mapInArrow(run, candidates_schema(marked, table.rows))
    return ranked(rows, "cosine", k).select("query_id", "rank", "id", F.col("cosine").alias("cosine_score"))
