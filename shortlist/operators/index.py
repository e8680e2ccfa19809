"""Text index of a catalog.

The forward index has one row per item: its term counts and the columns that
searches need. It is a table bucketed by ``id``: terms are counted inside the row,
and scoring groups and joins by ``id``, so a search moves no postings, no pairs
and no vectors between executors.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions.filters import minutes
from shortlist.functions.text import terms
from shortlist.session import delete_folder, sent_if_few, shared_folder

# Most ids that are sent to every task.
SENT_IDS = 100_000
META = ("test_types", "job_levels", "remote_testing", "adaptive", "minutes")


@dataclass(frozen=True)
class CatalogIndex:
    """The index tables.

    ``items``: id, embedding, the filter columns, ``terms`` (term, tf), ``length``;
    bucketed by id. ``term_stats``: term, df. ``corpus``: one row, n_items, n_ids and
    avg_length. ``catalog``: the full rows, joined only to final results.
    """

    catalog: DataFrame
    items: DataFrame
    term_stats: DataFrame
    corpus: DataFrame

    @property
    def postings(self) -> DataFrame:
        """One row per item and term."""
        return self.items.select("id", "length", F.inline("terms"))

    @property
    def unique(self) -> bool:
        """Whether every item has an id of its own."""
        return self.corpus.select(F.col("n_ids") == F.col("n_items")).first()[0]

    def only(self, ids: DataFrame) -> CatalogIndex:
        """The items with these ids, weighed as before by the statistics of all."""
        few = sent_if_few(ids.select("id").distinct(), SENT_IDS)
        return replace(self, items=self.items.join(few, "id", "left_semi"))


def counted(lists: pa.Array) -> pa.Array:
    """Lists of (term, tf) in the order of the terms, for lists of terms; NULL stays NULL."""
    coded = pc.list_flatten(lists).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    size = max(1, len(order))
    key = np.sort(owner * size + place[coded.indices.to_numpy(zero_copy_only=False)])
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    tf = np.diff(starts, append=len(key)).astype(np.int32)
    row, term = np.divmod(key[starts], size)
    runs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(order[term])), pa.array(tf)], ["term", "tf"])
    ends = np.searchsorted(row, np.arange(len(lists) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), runs, mask=lists.is_null())


def term_counts(rows: DataFrame, text) -> DataFrame:
    """Adds ``terms`` (array of term, tf) and ``length`` of a text column.

    Terms are counted as arrays, a batch of rows at a time: a lambda per term costs more.
    """

    @F.arrow_udf("array<struct<term: string, tf: int>>")
    def runs(lists: pa.Array) -> pa.Array:
        return counted(lists)

    found = rows.withColumn("_terms", terms(text))
    return found.withColumns({"terms": runs("_terms"), "length": F.size("_terms")}).drop("_terms")


def index_rows(catalog: DataFrame, parts: int) -> DataFrame:
    """Item rows, partitioned by id; search text is name + description.

    Rows are partitioned before their terms are counted, so that a few large
    input files do not decide how many tasks count.
    """
    placed = filter_rows(catalog, F.concat_ws(" ", "name", "description").alias("text"))
    return term_counts(placed.repartition(parts, "id"), F.col("text")).drop("text")


def filter_rows(catalog: DataFrame, *more: Column) -> DataFrame:
    """The columns that vector search and filters need; no text is read."""
    return catalog.withColumn("minutes", minutes(F.col("duration"))).select(
        "id", "embedding", *META, *more
    )


def _term_stats(items: DataFrame) -> DataFrame:
    terms_of = items.select(F.explode("terms.term").alias("term"))
    return terms_of.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _corpus(items: DataFrame) -> DataFrame:
    counts = F.count(F.lit(1)).alias("n_items"), F.count_distinct("id").alias("n_ids")
    return items.agg(*counts, F.avg("length").alias("avg_length"))


def build_index(catalog: DataFrame, name: str | None = None, buckets: int | None = None) -> CatalogIndex:
    """Build and store the index of a catalog.

    The tables are named ``<name>_items`` (bucketed by id), ``<name>_terms`` and
    ``<name>_corpus``; their files lie in the shared folder. Without a name the
    index is for this session, under a name of its own. A bucket should hold what
    one task can score: give ``buckets`` for catalogs beyond a few thousand million rows.
    """
    spark = catalog.sparkSession
    name = name or f"index_{uuid.uuid4().hex}"
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{shared_folder(spark)}/{name}"

    def store(df: DataFrame, part: str, bucketed: bool = False) -> None:
        writer = df.write.mode("overwrite").option("path", f"{folder}/{part}")
        (writer.bucketBy(n, "id") if bucketed else writer).saveAsTable(f"{name}_{part}")

    store(index_rows(catalog, n), "items", bucketed=True)
    items = spark.table(f"{name}_items")
    store(_term_stats(items), "terms")
    store(_corpus(items), "corpus")
    return open_index(catalog, name)


def open_index(catalog: DataFrame, name: str) -> CatalogIndex:
    """The stored index of a catalog."""
    parts = (catalog.sparkSession.table(f"{name}_{part}") for part in ("items", "terms", "corpus"))
    return CatalogIndex(catalog, *parts)


def drop_index(spark: SparkSession, name: str) -> None:
    """Forget a stored index and delete its files."""
    for part in ("items", "terms", "corpus"):
        spark.sql(f"DROP TABLE IF EXISTS {name}_{part}")
    delete_folder(spark, f"{shared_folder(spark)}/{name}")
