"""Postings stored by term, with the highest weight of each block of items.

Items are dealt into blocks of about ``block_items`` rows: first by the magnitude of their
length, as short items have the high weights, then by a hash of the id. The stored table
has one row per term and block: the highest weight of the term in the block and the
weights of its items. It is partitioned by a hash of the term, so a search reads only the
partitions of its terms (dynamic partition pruning), and their files are sorted by term.

A search first reads the highest weights alone. Their sums over the terms of a query bound
the score of every item of a block. The blocks with the highest bounds are scored; the
k-th best score found there drops, by a join, all blocks that cannot reach it, and the rest
are scored. For all terms, only blocks that hold every term remain before any weight of an
item is read. No block is dropped that could hold a result, so results are exact.

Ids are taken to be unique, as in the index. A query without a known term finds nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortlist.constants import DEFAULT_TOP_K, RANK_DIGITS
from shortlist.functions.bm25 import term_weight
from shortlist.operators.index import CatalogIndex
from shortlist.operators.lexical import eligible, ranked, weighted_terms
from shortlist.operators.queries import Limits, QueryTable, query_table
from shortlist.session import delete_folder, materialize, sent_if_few, shared_folder

BLOCK_ITEMS = 1024
BUCKETS = 64
# Blocks of a query that are scored to find its bound.
FIRST_BLOCKS = 4
MAX_SENT_PAIRS = 200_000
# Blocks whose postings a task sorts at once when they are stored.
BLOCKS_A_TASK = 4
# Scores are ranked after rounding, so a block this little below the bound may still hold a result.
_SLACK = 2 * 10.0**-RANK_DIGITS


@dataclass(frozen=True)
class TermPostings:
    """``blocks``: bucket, term, block, max_weight, weights (array of id, weight)."""

    index: CatalogIndex
    blocks: DataFrame
    buckets: int


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")


def _dealt(items: DataFrame, block_items: int) -> DataFrame:
    """Adds ``block``: items of like length, so many in each."""
    sized = items.withColumn("_size", F.floor(F.log2(F.col("length") + 1)).cast("long"))
    counts = sized.groupBy("_size").agg(F.ceil(F.count(F.lit(1)) / block_items).alias("_parts"))
    # A length has at most 31 magnitudes.
    parted = sized.join(F.broadcast(counts), "_size")
    block = F.shiftleft("_size", 48) + F.pmod(F.xxhash64("id"), F.col("_parts"))
    return parted.withColumn("block", block).drop("_size", "_parts")


def term_blocks(index: CatalogIndex, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(term, block, max_weight, weights): the postings of an index.

    Whole items are dealt to tasks by block, a few blocks each, so their postings are
    grouped where they are cut, without a shuffle of their own, and sorted in memory.
    """
    spark = index.items.sparkSession
    avg_length = index.corpus.select("avg_length").scalar()
    n_items = index.corpus.select("n_items").first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_items // (block_items * BLOCKS_A_TASK))
    dealt = _dealt(index.items.select("id", "length", "terms"), block_items).repartition(tasks, "block")
    rows = dealt.select("block", "id", "length", F.inline("terms"))
    rows = rows.withColumn("weight", term_weight(F.col("tf"), F.col("length"), avg_length))
    return rows.groupBy("term", "block").agg(
        F.max("weight").alias("max_weight"),
        F.sort_array(F.collect_list(F.struct("id", "weight"))).alias("weights"),
    )


def store_postings(
    index: CatalogIndex, name: str | None = None, buckets: int = BUCKETS, block_items: int = BLOCK_ITEMS
) -> TermPostings:
    """Store the postings of an index as table ``<name>_postings`` in the shared folder.

    Files of a frequent term's partition are split by size when they are written.
    """
    spark = index.items.sparkSession
    name = name or f"postings_{uuid.uuid4().hex}"
    blocks = term_blocks(index, block_items)
    placed = blocks.select(_bucket(buckets), "*").hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    writer = placed.write.mode("overwrite").partitionBy("bucket")
    writer.option("path", f"{shared_folder(spark)}/{name}").saveAsTable(f"{name}_postings")
    return open_postings(index, name, buckets)


def open_postings(index: CatalogIndex, name: str, buckets: int = BUCKETS) -> TermPostings:
    """The stored postings of an index; ``buckets`` as they were stored with."""
    return TermPostings(index, index.items.sparkSession.table(f"{name}_postings"), buckets)


def drop_postings(spark: SparkSession, name: str) -> None:
    """Forget stored postings and delete their files."""
    spark.sql(f"DROP TABLE IF EXISTS {name}_postings")
    delete_folder(spark, f"{shared_folder(spark)}/{name}")


def wanted_terms(table: QueryTable, postings: TermPostings) -> DataFrame:
    """(query_id, n_terms, term, idf, bucket) of the query terms that the index knows.

    The comparison always holds; Spark prunes partitions only for a filtered side.
    """
    known = weighted_terms(table, postings.index).select("*", _bucket(postings.buckets))
    return materialize(known).where(F.col("idf") > 0)


def block_bounds(table: QueryTable, postings: TermPostings, wanted: DataFrame, require_all: bool) -> DataFrame:
    """(query_id, block, bound): what the score of an item in the block can be at most.

    Reads the highest weights only, of the partitions of the terms.
    """
    heads = postings.blocks.select("bucket", "term", "block", "max_weight")
    met = heads.join(table.send(wanted), ["bucket", "term"])
    bounds = met.groupBy("query_id", "block").agg(
        F.sum(F.col("idf") * F.col("max_weight")).alias("bound"),
        F.count(F.lit(1)).alias("matched"),
        F.max("n_terms").alias("n_terms"),
    )
    if require_all:
        bounds = bounds.where(F.col("matched") == F.col("n_terms"))
    return bounds.select("query_id", "block", "bound")


def block_scores(
    chosen: DataFrame, table: QueryTable, postings: TermPostings, wanted: DataFrame, require_all: bool
) -> DataFrame:
    """(query_id, id, raw): the eligible items of chosen (query_id, block) pairs."""
    pairs = materialize(chosen.select("query_id", "block").join(table.send(wanted), "query_id"))
    # Always true, as above; what ``wanted`` is known to meet would be left out.
    pairs = sent_if_few(pairs, MAX_SENT_PAIRS).where(F.length("term") > 0)
    met = postings.blocks.join(pairs, ["bucket", "term", "block"])
    each = met.select("query_id", "n_terms", "idf", F.inline("weights"))
    sums = each.groupBy("id", "query_id").agg(
        F.sum(F.col("idf") * F.col("weight")).alias("raw"),
        F.count(F.lit(1)).alias("matched"),
        F.max("n_terms").alias("n_terms"),
    )
    if require_all:
        sums = sums.where(F.col("matched") == F.col("n_terms"))
    return eligible(sums, table, postings.index).select("query_id", "id", "raw")


def first_blocks(bounds: DataFrame) -> DataFrame:
    """(query_id, block): the few blocks of each query with the highest bounds."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    placed = bounds.withColumn("place", F.row_number().over(order))
    return placed.where(F.col("place") <= FIRST_BLOCKS).select("query_id", "block")


def reachable(bounds: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(query_id, block): the other blocks that may hold one of the k best.

    A query with fewer than k results so far keeps all its blocks.
    """
    least = found.where(F.col("rank") == k).select("query_id", F.col("raw").alias("least"))
    others = bounds.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    reach = F.col("least").isNull() | (F.col("bound") + _SLACK >= F.col("least"))
    return others.where(reach).select("query_id", "block")


def search_postings(
    queries: DataFrame,
    postings: TermPostings,
    k: int = DEFAULT_TOP_K,
    require_all: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_id, rank, id, bm25_score): as ``search_lexical``, from the stored postings."""
    table = query_table(queries, limits)
    wanted = wanted_terms(table, postings)
    how = table, postings, wanted, require_all
    bounds = materialize(block_bounds(*how))
    first = materialize(first_blocks(bounds))
    found = materialize(ranked(block_scores(first, *how), "raw", k))
    rest = block_scores(reachable(bounds, first, found, k), *how)
    both = found.select("query_id", "id", "raw").unionByName(rest)
    return ranked(both, "raw", k).select("query_id", "rank", "id", F.col("raw").alias("bm25_score"))
