"""Nearest neighbours by cosine: exact, and through coarse cells."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.constants import DEFAULT_TOP_K, EMBEDDING_DIM
from shortlist.functions.text import run_lengths, run_starts, terms
from shortlist.operators.blocks import (
    ITEM_COLUMNS,
    ITEMS_PER_CELL,
    QUERIES_PER_CELL,
    QUERY_COLUMNS,
    Scoring,
    candidates_schema,
    in_cells,
    score_block,
    top_k_candidates,
)
from shortlist.operators.filters import numbered
from shortlist.operators.lexical import ranked
from shortlist.operators.queries import Limits, query_table
from shortlist.session import materialize, sent_if_few

MAX_CELLS_SENT = 100_000


def hashing_encoder(dim: int = EMBEDDING_DIM):
    """Encoder for when no model is at hand: hashed term counts, unit length.

    A term counts in the place that the first eight hex digits of its md5 give,
    so any engine can compute the vector. A text without terms has zeros only.
    """

    def place(term: Column) -> Column:
        return (F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("long") % dim).cast("int")

    def encode(texts: DataFrame) -> DataFrame:
        known = F.array_sort(F.transform(terms(F.coalesce("text", F.lit(""))), place))
        rows = texts.withColumn("_places", known)
        rows = rows.withColumn("_starts", run_starts(F.col("_places")))
        runs = run_lengths(F.col("_places"), F.col("_starts"))
        rows = rows.withColumn("_runs", runs)
        squares = F.aggregate("_runs.tf", F.lit(0).cast("long"), lambda a, n: a + n.cast("long") * n)
        norm = F.sqrt(F.greatest(squares, F.lit(1)))
        held = F.struct(F.map_from_entries("_runs").alias("counts"), norm.alias("norm"))
        places = F.sequence(F.lit(0), F.lit(dim - 1))

        def vector(h: Column) -> Column:
            return F.transform(
                places, lambda i: (F.coalesce(F.try_element_at(h["counts"], i), F.lit(0)) / h["norm"]).cast("float")
            )

        # Bound by a lambda, so that counts and norm are computed once per text.
        return rows.withColumn("vector", F.transform(F.array(held), vector)[0]).drop("_places", "_starts", "_runs")

    return encode


def search_vector(
    queries: DataFrame, items: DataFrame, k: int = DEFAULT_TOP_K, limits: Limits = Limits()
) -> DataFrame:
    """(query_id, rank, id, cosine_score): exact nearest items that meet the filters.

    ``items`` needs id, embedding and the filter columns, as in an index. Items
    and queries without a (non-zero) vector do not take part.
    """
    marked, table = numbered(items, query_table(queries, limits))
    found = ranked(top_k_candidates(marked, table, Scoring(k=k)), "cosine", k)
    return found.select("query_id", "rank", "id", F.col("cosine").alias("cosine_score"))


def _as_items(rows: DataFrame) -> DataFrame:
    """Give rows (id, embedding) empty filter columns."""
    empty = {
        "test_types": "array<string>",
        "job_levels": "array<string>",
        "remote_testing": "boolean",
        "adaptive": "boolean",
        "minutes": "int",
    }
    return rows.withColumns({n: F.lit(None).cast(t) for n, t in empty.items()})


def cell_centroids(items: DataFrame) -> DataFrame:
    """(id, embedding): mean vector of each given ``cell``."""
    known = items.where(F.col("embedding").isNotNull())
    mean = Summarizer.mean(array_to_vector("embedding"))
    means = known.groupBy("cell").agg(mean.alias("mean"))
    return means.select(F.col("cell").alias("id"), vector_to_array("mean").alias("embedding"))


def build_cells(items: DataFrame, n_cells: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Group items into coarse cells with k-means: (items with ``cell``, centroids)."""
    known = items.where(F.col("embedding").isNotNull())
    data = known.withColumn("_v", array_to_vector("embedding"))
    model = KMeans(k=n_cells, seed=seed, featuresCol="_v", predictionCol="cell").fit(data)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = items.sparkSession.createDataFrame(centres, "id int, embedding array<double>")
    return model.transform(data).drop("_v"), centroids


def probed_cells(queries: DataFrame, centroids: DataFrame, n_probe: int, limits: Limits = Limits()) -> DataFrame:
    """(query_id, cell): the ``n_probe`` cells nearest to each query, stored."""
    plain = queries.select("query_id", "vector")
    found = search_vector(plain, _as_items(centroids), n_probe, limits)
    return materialize(found.select("query_id", F.col("id").alias("cell")))


def search_cells(
    queries: DataFrame,
    items: DataFrame,
    centroids: DataFrame,
    n_probe: int,
    k: int = DEFAULT_TOP_K,
    limits: Limits = Limits(),
) -> DataFrame:
    """Nearest items among those in the ``n_probe`` cells nearest to the query.

    A large cell is cut into parts of bounded size by a hash of the id, and the
    queries that probe it are cut likewise, so no task holds a whole hot cell.
    """
    marked, table = numbered(items, query_table(queries, limits))
    probes = probed_cells(queries, centroids, n_probe, limits)
    asked = probes.join(table.rows, "query_id")
    here = marked.where(F.col("embedding").isNotNull())
    blocks = _cuts(here, "cell", ITEMS_PER_CELL).join(
        _cuts(probes, "cell", QUERIES_PER_CELL).withColumnRenamed("cuts", "query_cuts"),
        "cell",
    )
    # One row per cell: sent to the items, so that no hot cell is shuffled whole.
    blocks = sent_if_few(materialize(blocks), MAX_CELLS_SENT)
    key = F.struct("cell", "cut").alias("cell")
    left = here.join(blocks, "cell").select(
        *ITEM_COLUMNS,
        F.struct("cell", _cut("id", "cuts")).alias("cell"),
        F.explode(F.sequence(F.lit(0), F.col("query_cuts") - 1)).alias("part"),
    )
    right = (
        asked.join(blocks, "cell")
        .withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("query_cuts")).cast("int"))
        .withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(*QUERY_COLUMNS, key, "part")
    )
    how = Scoring(k=k)
    found = in_cells(
        left, right, lambda i, q: score_block(i, q, how), candidates_schema(items, table.rows)
    )
    return ranked(found, "cosine", k).select(
        "query_id", "rank", "id", F.col("cosine").alias("cosine_score")
    )


def _cut(key: str, cuts: str):
    return F.pmod(F.xxhash64(key), F.col(cuts)).cast("int").alias("cut")


def _cuts(rows: DataFrame, key: str, most: int) -> DataFrame:
    """How many parts each key is cut into so that a part holds about ``most`` rows."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(key, F.ceil(F.col("n") / most).cast("int").alias("cuts"))
