"""Fusion of keyword and vector scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.constants import DEFAULT_TOP_K, LEXICAL_WEIGHT, RANK_DIGITS
from shortlist.functions.vectors import cosine
from shortlist.operators.blocks import (
    ITEM_WORDS,
    ITEMS_WITH_WORDS,
    QUERY_WORDS,
    Scoring,
    best_hits_block,
    each_block,
    fused_block,
    top_k_candidates,
    word_ranges,
)
from shortlist.operators.filters import count_eligible, numbered
from shortlist.operators.index import CatalogIndex
from shortlist.operators.lexical import lexical_hits, ranked, with_words
from shortlist.operators.queries import Limits, QueryTable, query_table
from shortlist.session import materialize, sent_if_few

KEYS = ["query_id", "id"]
# So many times k items of both lists get full scores before the bound is set.
DEPTH = 10
# Most (query_id, id) pairs that are sent to every task.
SENT_PAIRS = 100_000
# Most ids of items that are sent to the catalog.
SENT_ITEMS = 1_000_000
# Items of the smallest sample at least, and the growth from one sample to the next.
FIRST_SAMPLE = 8_192
GROWTH = 16
_SLACK = 4 * 10.0**-RANK_DIGITS


def scaled(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling: 0 if the maximum is 0, and 1 for all if all are equal."""
    return (
        F.when(high == 0, F.lit(0.0))
        .when(high == low, F.when(value > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        .otherwise((value - low) / (high - low))
    )


def _low(n_hits: Column, n_eligible: Column, least: Column) -> Column:
    """Items without a hit score 0, so that is the minimum unless all are hits."""
    return F.when(n_hits < n_eligible, F.lit(0.0)).otherwise(least)


def _low_of_ranges() -> Column:
    """The same for rows of ``_ranges``: an item that was missed scores 0."""
    return F.when(F.col("missed") > 0, F.lit(0.0)).otherwise(F.col("least"))


def _scales(hits: DataFrame, table: QueryTable, index: CatalogIndex) -> DataFrame:
    """(query_id, high, low): the ends of the scale of each query that has hits.

    One row per query; stored, as a search scales its hits more than once.
    """
    bounds = hits.groupBy("query_id").agg(
        F.max("raw").alias("high"), F.min("raw").alias("least"), F.count(F.lit(1)).alias("n_hits")
    )
    if table.n_filtered:
        counted = bounds.join(table.send(count_eligible(index.items, table)), "query_id")
    else:
        counted = bounds.withColumn("n_eligible", index.corpus.select("n_items").scalar())
    low = _low(F.col("n_hits"), F.col("n_eligible"), F.col("least"))
    return materialize(counted.select("query_id", "high", low.alias("low")))


def minmax(hits: DataFrame, table: QueryTable, index: CatalogIndex, known: DataFrame | None = None) -> DataFrame:
    """(query_id, id, value): lexical scores scaled over all eligible items.

    Items without a hit need no rows: their scaled score is 0 as well. ``known`` are the
    scales of ``best_hits``; without them ``hits`` must be complete.
    """
    if known is None:
        known = _scales(hits, table, index)
    return hits.join(table.send(known), "query_id").select(
        "query_id", "id", scaled(F.col("raw"), F.col("low"), F.col("high")).alias("value")
    )


def best_hits(table: QueryTable, index: CatalogIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, value, rank) of the k best hits by scaled keyword score, and all scales.

    The scales are (query_id, high, low), stored. Blocks of items leave a row per query, then
    k; other hits are no rows. Ids that repeat have all their hits summed by joins.
    """
    if not (table.unique and index.unique):
        hits = lexical_hits(table, index)
        known = _scales(hits, table, index)
        return ranked(minmax(hits, table, index, known), "value", k), known
    items, asked = with_words(*numbered(index.items, table), index)
    ranges = _ranges(items, asked, None).select("query_id", "high", _low_of_ranges().alias("low"))
    scales = ranges.select("query_id", "low", (F.col("high") - F.col("low")).alias("span"))
    scaled_queries = asked.having(asked.rows.join(table.send(scales), "query_id", "left"))

    def step(items, queries):
        return best_hits_block(items, queries, k)

    found = each_block(items, scaled_queries, step, ITEM_WORDS, (*QUERY_WORDS, "low", "span"), ("query_id", "id", "value"))
    return ranked(found, "value", k), ranges


def join_scores(pairs: DataFrame, lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Both scores of (query_id, id) pairs; missing scores are 0.

    Scores of other pairs are dropped before the join.
    """
    keys = ["query_id", "id"]
    asked = sent_if_few(pairs.select(*keys), SENT_PAIRS)
    bm25 = lexical.select(*keys, F.col("value").alias("bm25_score")).join(asked, keys, "left_semi")
    cosine = vector.select(*keys, "cosine_score")
    return (
        pairs.select(*keys)
        .join(bm25, keys, "left")
        .join(cosine, keys, "left")
        .na.fill(0.0, ["bm25_score", "cosine_score"])
    )


def fuse(scores: DataFrame, alpha: float | None = None) -> DataFrame:
    """Adds ``score`` = alpha * bm25 + (1 - alpha) * cosine."""
    weight = LEXICAL_WEIGHT if alpha is None else alpha
    return scores.withColumn(
        "score", weight * F.col("bm25_score") + (1.0 - weight) * F.col("cosine_score")
    )


def _with_cosines(pairs: DataFrame, table: QueryTable, index: CatalogIndex) -> DataFrame:
    """Adds ``cosine`` to (query_id, id) pairs; 0 where a vector is missing."""
    queries = table.rows.select("query_id", "vector")
    rows = pairs.join(table.send(queries), "query_id").join(index.items.select("id", "embedding"), "id")
    value = F.nanvl(cosine(F.col("vector"), F.col("embedding")), F.lit(0.0))
    return rows.select(*pairs.columns, F.coalesce(value, F.lit(0.0)).alias("cosine"))


def search_hybrid(
    queries: DataFrame,
    index: CatalogIndex,
    k: int = DEFAULT_TOP_K,
    alpha: float | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """(query_id, rank, id, score, bm25_score, cosine_score) of the k best items.

    Items stay where they lie and are read twice: first for the range of the keyword scores
    of each query, a row per query and block, then for the k best of each block by full
    score. No hit is stored; only the k best of a query get rows with a cosine of their own.
    Many queries meet ``_samples`` of the items before: a block of items then leaves only
    rows that change the range or reach the k-th best score, so rows do not grow with the
    blocks. Ids that repeat are searched by ``_joined_search``.
    """
    weight = LEXICAL_WEIGHT if alpha is None else alpha
    table = query_table(queries, limits)
    if not (table.unique and index.unique):
        return _joined_search(table, index, k, weight)
    items, asked = with_words(*numbered(index.items, table), index)
    samples = [] if table.small else _samples(items, index)
    ranges = None
    for some in (*samples, items):
        known = asked if ranges is None else asked.having(asked.rows.join(table.send(ranges), "query_id", "left"))
        ranges = _ranges(some, known, ranges)
    low = _low_of_ranges()
    scales = ranges.select("query_id", low.alias("low"), (F.col("high") - low).alias("span"))
    scaled_queries = asked.having(asked.rows.join(table.send(scales), "query_id", "left"))
    how = Scoring(k, weight, vectors_only=False)

    def step(items, queries):
        return fused_block(items, queries, how)

    def best_of(items, table):
        more = [c for c in ("low", "span", "bound") if c in table.rows.columns]
        columns = (*ITEM_WORDS, "embedding"), (*QUERY_WORDS, "vector", *more)
        return ranked(each_block(items, table, step, *columns, ("query_id", "id", "value", "score")), "score", k)

    for some in samples:
        bounds = best_of(some, scaled_queries).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        rows = scaled_queries.rows.drop("bound")
        scaled_queries = scaled_queries.having(rows.join(materialize(bounds), "query_id", "left"))
    # Stored, as it is small and the items are not to be read again for it.
    best = materialize(best_of(items, scaled_queries).select(*KEYS, "value"))
    return ranked(_fused(_with_cosines(best, table, index), weight), "score", k).select(
        "query_id", "rank", "id", "score", F.col("value").alias("bm25_score"), F.col("cosine").alias("cosine_score")
    )


def _samples(items: DataFrame, index: CatalogIndex) -> list[DataFrame]:
    """Samples of the items by a hash of the id, from about ``FIRST_SAMPLE`` items on.

    Each holds about ``GROWTH`` times the one before and lies in whole blocks. They only
    tell how few rows the search over all items may leave.
    """
    n, share, samples = index.corpus.select("n_items").first()[0], GROWTH, []
    while n // share >= FIRST_SAMPLE:
        some = items.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
        samples.insert(0, materialize(some.coalesce(math.ceil(n / share / ITEMS_WITH_WORDS))))
        share *= GROWTH
    return samples


def _ranges(items: DataFrame, table: QueryTable, before: DataFrame | None) -> DataFrame:
    """(query_id, high, least, missed) of the keyword scores of items, one row per query; stored."""
    columns = ("query_id", "high", "least", "missed")
    queries = QUERY_WORDS if before is None else (*QUERY_WORDS, *columns[1:])
    found = each_block(items, table, word_ranges, ITEM_WORDS, queries, columns)
    found = found if before is None else found.unionByName(before)
    ends = F.max("high").alias("high"), F.min("least").alias("least"), F.max("missed").alias("missed")
    return materialize(found.groupBy("query_id").agg(*ends))


def _joined_search(table: QueryTable, index: CatalogIndex, k: int, weight: float) -> DataFrame:
    """``search_hybrid`` for ids that repeat, whose rows count together: hits are stored.

    The items that share no term with a query get no row, but for the nearest ones: an
    item that is not among the k nearest has k others before it by vector, and those
    cannot lose rank by their keyword scores, so without a hit it is not among the k
    best. Hits (an equi-join on terms) and the nearest are therefore complete. The
    ``DEPTH`` * k best of both lists get full scores; the k-th best of these is a bound.
    Any other hit has at most the vector part of the last of the nearest, so only hits
    that could reach the bound with that get their cosines and are ranked.
    """
    marked, asked = numbered(index.items, table)
    deep = DEPTH * k
    nearest = ranked(top_k_candidates(marked, asked, Scoring(deep, 1.0 - weight, vectors_only=False)), "score", deep)
    nearest = materialize(nearest.select(*KEYS, "cosine", F.col("score").alias("part"), F.col("rank").alias("place")))
    scaled = minmax(materialize(lexical_hits(table, index)), table, index)
    if weight > 0:
        words = ranked(scaled, "value", deep).select(*KEYS)
        others = _with_cosines(words.join(nearest, KEYS, "left_anti"), table, index)
        known = nearest.select(*KEYS, "cosine").unionByName(others)
    else:
        known = nearest.select(*KEYS, "cosine")
    known = materialize(_fused(known.join(scaled, KEYS, "left").na.fill(0.0, ["value"]), weight))
    if weight > 0:
        known = known.unionByName(_reaching(known, nearest, scaled, table, index, k, weight))
    return ranked(known, "score", k).select(
        "query_id", "rank", "id", "score", F.col("value").alias("bm25_score"), F.col("cosine").alias("cosine_score")
    )


def _fused(rows: DataFrame, weight: float) -> DataFrame:
    """(query_id, id, value, cosine, score) of rows with both parts."""
    score = weight * F.col("value") + (1.0 - weight) * F.col("cosine")
    return rows.select(*KEYS, "value", "cosine", score.alias("score"))


def _reaching(
    known: DataFrame, nearest: DataFrame, scaled: DataFrame, table: QueryTable, index: CatalogIndex, k: int, weight: float
) -> DataFrame:
    """The other hits that could be among the k best, with their scores.

    A query with fewer than ``DEPTH`` * k nearest items has no others.
    """
    bound = ranked(known, "score", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
    part = nearest.where(F.col("place") == DEPTH * k).select("query_id", "part")
    limit = materialize(bound.join(part, "query_id"))
    open_hits = scaled.join(table.send(limit), "query_id")
    open_hits = open_hits.where(weight * F.col("value") + F.col("part") >= F.col("bound") - _SLACK).select(*KEYS, "value")
    return _fused(_with_cosines(open_hits.join(known.select(*KEYS), KEYS, "left_anti"), table, index), weight)


def with_details(hits: DataFrame, catalog: DataFrame, few: bool = False) -> DataFrame:
    """Adds the descriptive columns of the items.

    ``few`` says that the hits are bounded (k rows for each of few queries): they
    are sent to the catalog, which then is scanned but not shuffled. The hits are stored,
    and their ids go to the catalog first, so that a catalog that is itself a join does
    not shuffle the texts of other items.
    """
    names = (
        "name",
        "url",
        "test_types",
        "description",
        "duration",
        "job_levels",
        "remote_testing",
        "adaptive",
    )
    hits = materialize(hits)
    asked = sent_if_few(hits.select("id").distinct(), SENT_ITEMS)
    rows = catalog.select("id", *names).where(F.col("id").isin(asked))
    return rows.join(F.broadcast(hits), "id") if few else hits.join(rows, "id")
