"""BM25 scores and keyword search over an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.constants import DEFAULT_TOP_K, RANK_DIGITS
from shortlist.functions.bm25 import term_weight
from shortlist.functions.filters import permits
from shortlist.operators.blocks import ITEM_WORDS, QUERY_WORDS, each_block, word_hits
from shortlist.operators.filters import numbered
from shortlist.operators.index import META, CatalogIndex
from shortlist.operators.queries import Limits, QueryTable, query_table, query_terms
from shortlist.session import materialize

SALTS = 16


def idf(df: Column, n_items: Column) -> Column:
    """Inverse document frequency, always above zero."""
    return F.log(1 + (n_items - df + 0.5) / (df + 0.5))


def weighted_terms(table: QueryTable, index: CatalogIndex) -> DataFrame:
    """(query_id, n_terms, term, idf) of the query terms that the index knows."""
    known = index.term_stats.join(table.send(query_terms(table.rows)), "term")
    n_items = index.corpus.select("n_items").scalar()
    return known.select("query_id", "n_terms", "term", idf(F.col("df"), n_items).alias("idf"))


def with_words(items: DataFrame, table: QueryTable, index: CatalogIndex) -> tuple[DataFrame, QueryTable]:
    """Items with ``words``, ``tfs`` and lengths, queries with ``words``, ``idfs`` and ``n_terms``.

    Items bring plain counts: tasks weigh them as arrays, not term by term in a lambda.
    """
    avg_length = F.lit(index.corpus.select("avg_length").first()[0]).cast("double")
    counts = {"words": F.col("terms.term"), "tfs": F.col("terms.tf"), "avg_length": avg_length}
    counted = items.withColumns(counts).drop("terms")
    grouped = weighted_terms(table, index).groupBy("query_id")
    words = grouped.agg(
        F.collect_list(F.struct("term", "idf")).alias("_words"), F.max("n_terms").cast("double").alias("n_terms")
    )
    # Stored: the terms are looked up once, however often the items are read.
    words = materialize(words.select("query_id", "n_terms", F.col("_words.term").alias("words"), F.col("_words.idf").alias("idfs")))
    none = F.coalesce("words", F.array().cast("array<string>")), F.coalesce("idfs", F.array().cast("array<double>"))
    rows = table.rows.drop("text").join(table.send(words), "query_id", "left")
    return counted, table.having(rows.withColumns({"words": none[0], "idfs": none[1]}))


def lexical_hits(table: QueryTable, index: CatalogIndex, require_all: bool = False) -> DataFrame:
    """(query_id, id, raw): every eligible item that shares a term with a query.

    Items stay where they lie and meet the queries block by block, so a hit is a row only
    when it leaves. Ids that repeat need all rows of an id: their hits are summed by joins.
    """
    if not (table.unique and index.unique):
        return _joined_hits(table, index, require_all)
    marked, asked = numbered(index.items, table)
    marked, asked = with_words(marked, asked, index)

    def step(items, queries):
        return word_hits(items, queries, require_all)

    return each_block(marked, asked, step, ITEM_WORDS, QUERY_WORDS, ("query_id", "id", "raw"))


def _joined_hits(table: QueryTable, index: CatalogIndex, require_all: bool) -> DataFrame:
    """``lexical_hits`` for ids that repeat: rows of equal ids count together.

    With few queries their terms go to the postings, which stay where they are;
    the sums group by id and reuse the partitioning of the index. With many
    queries both sides are shuffled on (term, salt), so a term that occurs in a
    large part of the catalog is spread over many tasks.
    """
    wanted = weighted_terms(table, index)
    avg_length = index.corpus.select("avg_length").scalar()
    postings = index.postings
    if table.small:
        pairs = postings.join(F.broadcast(wanted), "term")
    else:
        salted = postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        spread = wanted.withColumn(
            "salt", F.explode(F.array(*[F.lit(s).cast("long") for s in range(SALTS)]))
        )
        pairs = salted.join(spread, ["term", "salt"])
    weight = F.col("idf") * term_weight(F.col("tf"), F.col("length"), avg_length)
    sums = pairs.groupBy("id", "query_id").agg(
        F.sum(weight).alias("raw"),
        F.count(F.lit(1)).alias("matched"),
        F.max("n_terms").alias("n_terms"),
    )
    if require_all:
        sums = sums.where(F.col("matched") == F.col("n_terms"))
    return eligible(sums, table, index).select("query_id", "id", "raw")


def eligible(scores: DataFrame, table: QueryTable, index: CatalogIndex) -> DataFrame:
    """Keep the pairs that meet the filters of their query."""
    if not table.n_filtered:
        return scores
    filters = table.rows.select("query_id", "filters").where(F.col("filters").isNotNull())
    meta = index.items.select("id", *META)
    known = scores.join(table.send(filters), "query_id", "left").join(meta, "id")
    passes = permits(F.col("filters"), {name: F.col(name) for name in META})
    return known.where(F.col("filters").isNull() | passes)


def ranked(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows per query by rounded score, then id, with ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, RANK_DIGITS).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_lexical(
    queries: DataFrame,
    index: CatalogIndex,
    k: int = DEFAULT_TOP_K,
    require_all: bool = True,
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_id, rank, id, bm25_score): best items that contain the query terms.

    Hits are found where the items lie, and Spark keeps the k best of each partition
    and query before it shuffles for the rank.
    """
    hits = lexical_hits(query_table(queries, limits), index, require_all)
    found = ranked(hits.where(F.col("raw") > 0), "raw", k)
    return found.select("query_id", "rank", "id", F.col("raw").alias("bm25_score"))
