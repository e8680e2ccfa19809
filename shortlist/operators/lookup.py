"""Lookups by url and name, and checks of given urls against the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.constants import MAX_RECOMMENDATIONS
from shortlist.functions.text import strip
from shortlist.operators.joins import SALTS, spread_join
from shortlist.operators.names import StoredNames, resolve_stored
from shortlist.schemas import RECOMMENDATION
from shortlist.session import materialize, sent_if_few
from shortlist.sources.catalog import coerce_nulls, type_codes

# Lengths of the substrings that carry a "contains" lookup.
SHORT, LONG = 3, 8
# Most keys (urls, names, substrings) that are sent to every task.
SENT_KEYS = 100_000


def lookup_by_url(keys: DataFrame, catalog: DataFrame) -> DataFrame:
    """Catalog row of each distinct url; NULL columns where there is none."""
    asked = keys.select("url").distinct()
    rows = coerce_nulls(catalog).drop("embedding")
    met = rows.join(sent_if_few(asked, SENT_KEYS), "url", "left_semi")
    first = met.groupBy("url").agg(F.min("id").alias("id"))
    return asked.join(met.join(first, ["url", "id"]), "url", "left")


def _pieces(text: Column, size: int) -> Column:
    """Distinct substrings of one length."""
    spots = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(size))))


def _contained_short(needles: DataFrame, names: DataFrame) -> DataFrame:
    """Needles of at most SHORT characters: lowest id per substring, then one join."""
    none = F.array().cast("array<string>")
    sizes = range(1, SHORT + 1)
    every = F.flatten(F.array(*[F.coalesce(_pieces(F.col("key"), n), none) for n in sizes]))
    lowest = (
        names.select("id", F.explode(every).alias("needle"))
        .groupBy("needle")
        .agg(F.min("id").alias("id"))
    )
    short = needles.where(F.length("key") <= SHORT).withColumnRenamed("key", "needle")
    return short.join(lowest, "needle")


def _contained_long(needles: DataFrame, names: DataFrame, size: int) -> DataFrame:
    """Longer needles: meet the names that share their rarest piece, then check."""
    carried = names.select("id", "key", F.explode(_pieces(F.col("key"), size)).alias("piece"))
    asked = needles.select(
        F.col("key").alias("needle"), F.explode(_pieces(F.col("key"), size)).alias("piece")
    )
    pieces = sent_if_few(asked.select("piece").distinct(), SENT_KEYS)
    counts = (
        carried.join(pieces, "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    )
    rarest = (
        asked.join(counts, "piece", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("best"))
        .where(F.col("best.n") > 0)
        .select("needle", F.col("best.piece").alias("piece"))
    )
    salted = carried.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    spread = rarest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = salted.join(spread, ["piece", "salt"]).where(F.col("key").contains(F.col("needle")))
    return met.groupBy("needle").agg(F.min("id").alias("id"))


def _equal_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(key, id) of each distinct lower-case name: the lowest id of that name, or NULL.

    Only catalog rows with one of the names are grouped; a few names are sent to
    the catalog, which then stays where it is.
    """
    key = F.lower("name").alias("key")
    asked = materialize(names.select(key).where(strip(F.col("key")) != "").distinct())
    rows = catalog.select("id", key)
    given = rows.join(sent_if_few(asked, SENT_KEYS), "key", "left_semi")
    return asked.join(given.groupBy("key").agg(F.min("id").alias("id")), "key", "left")


def resolve_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(needle, id) of each distinct lower-case name that can be found.

    Equal names first, else the lowest id whose name contains the needle. The
    "contains" step is an equi-join on substrings, made for the misses only.
    Blank names find nothing.
    """
    looked = materialize(_equal_names(names, catalog))
    given = catalog.groupBy(F.lower("name").alias("key")).agg(F.min("id").alias("id"))
    found = looked.where(F.col("id").isNotNull()).select(F.col("key").alias("needle"), "id")
    misses = looked.where(F.col("id").isNull()).select("key")
    size = F.length("key")
    short, long = size <= SHORT, size >= LONG
    counts = misses.agg(F.count_if(short), F.count_if(~short & ~long), F.count_if(long)).first()
    if counts[0]:
        found = found.unionByName(_contained_short(misses, given))
    if counts[1]:
        found = found.unionByName(_contained_long(misses.where(~short & ~long), given, SHORT))
    if counts[2]:
        found = found.unionByName(_contained_long(misses.where(long), given, LONG))
    return found


def exact_names(names: DataFrame, catalog: DataFrame) -> DataFrame:
    """(needle, id): equality of lower-case names only."""
    return _equal_names(names, catalog).where(F.col("id").isNotNull()).select(F.col("key").alias("needle"), "id")


def _resolved(names: DataFrame, catalog: DataFrame, stored: StoredNames | None) -> DataFrame:
    """(needle, id) from the stored names if given, else from the catalog."""
    return resolve_names(names, catalog) if stored is None else resolve_stored(names, stored)


def lookup_by_name(names: DataFrame, catalog: DataFrame, stored: StoredNames | None = None) -> DataFrame:
    """Catalog row of each distinct (lower-case) name; NULL columns if not found."""
    asked = names.select(F.lower("name").alias("needle")).distinct()
    rows = coerce_nulls(catalog).drop("embedding")
    found = rows.join(sent_if_few(materialize(_resolved(names, catalog, stored)), SENT_KEYS), "id")
    return asked.join(found, "needle", "left")


def _checked(rows: DataFrame, catalog: DataFrame, how: str) -> DataFrame:
    """The distinct urls of ``rows`` that are (not) in the catalog."""
    asked = rows.select("url").distinct()
    sent = sent_if_few(asked, SENT_KEYS)
    known = catalog.select("url").join(sent, "url", "left_semi").distinct()
    return known if how == "left_semi" else asked.join(known, "url", how)


def invalid_urls(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows with a non-empty url that the catalog lacks; repeats are kept."""
    given = rows.where(F.coalesce("url", F.lit("")) != "")
    return spread_join(given, _checked(given, catalog, "left_anti"), "url", "left_semi")


def valid_recommendations(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose url is in the catalog."""
    return spread_join(rows, _checked(rows, catalog, "left_semi"), "url", "left_semi")


def repair_recommendations(
    responses: DataFrame,
    catalog: DataFrame,
    most: int = MAX_RECOMMENDATIONS,
    stored: StoredNames | None = None,
) -> DataFrame:
    """(conv_id, recommendations): each item with a catalog url stays as it is,
    else it is replaced by the item its name leads to, else dropped; in order,
    at most ``most``. Every conversation keeps its row. Names are looked up in the
    stored names if they are given."""
    items = responses.select("conv_id", F.posexplode("recommendations").alias("pos", "item"))
    rows = materialize(
        items.select(
            "conv_id",
            "pos",
            "item",
            F.col("item.url").alias("url"),
            F.lower("item.name").alias("needle"),
        )
    )
    valid = _checked(rows, catalog, "left_semi").withColumn("valid", F.lit(True))
    marked = spread_join(rows, valid, "url")
    wrong = marked.where(F.col("valid").isNull()).select(F.col("item.name").alias("name"))
    found = _resolved(wrong, catalog, stored).join(
        catalog.select("id", "name", "url", type_codes().alias("test_type")), "id"
    )
    named = found.select("needle", F.struct("name", "url", "test_type").cast(RECOMMENDATION).alias("other"))
    resolved = spread_join(marked, named, "needle").withColumn(
        "kept", F.when(F.col("valid"), F.col("item")).otherwise(F.col("other"))
    )
    lists = (
        resolved.where(F.col("kept").isNotNull())
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "kept"))).alias("items"))
        .select("conv_id", F.slice(F.col("items")["kept"], 1, most).alias("recommendations"))
    )
    none = F.array().cast(lists.schema["recommendations"].dataType)
    return (
        responses.select("conv_id")
        .join(lists, "conv_id", "left")
        .select("conv_id", F.coalesce("recommendations", none).alias("recommendations"))
    )
