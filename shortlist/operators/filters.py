"""Filters on the catalog: one at a time, together, and one set per query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.filters import minutes, overlaps, permits
from shortlist.operators.index import META
from shortlist.operators.queries import Limits, QueryTable, query_table
from shortlist.session import MAX_SENT_BYTES, materialize, sent_if_few

# Most kinds of items (distinct filter columns) that are sent to every task.
MAX_SENT_KINDS = 100_000
_ANY = "*"


def _listed(values: str | list[str]):
    given = [values] if isinstance(values, str) else values
    return F.array(*[F.lit(v) for v in given]).cast("array<string>")


CONDITIONS = {
    "test_type": lambda v: overlaps(F.col("test_types"), _listed(v)),
    "job_level": lambda v: overlaps(F.col("job_levels"), _listed(v)),
    "remote_testing": lambda v: F.col("remote_testing") == v,
    "adaptive": lambda v: F.col("adaptive") == v,
    "duration_max": lambda v: minutes(F.col("duration")) <= v,
}


def apply_filters(catalog: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that meet all given filters; an absent key does not constrain."""
    parts = [CONDITIONS[name](value) for name, value in (filters or {}).items()]
    return catalog.where(reduce(lambda a, b: a & b, parts)) if parts else catalog


def filter_test_type(catalog: DataFrame, codes: str | list[str]) -> DataFrame:
    """Rows with one of the type codes."""
    return apply_filters(catalog, {"test_type": codes})


def filter_job_level(catalog: DataFrame, levels: str | list[str]) -> DataFrame:
    """Rows with one of the job levels."""
    return apply_filters(catalog, {"job_level": levels})


def filter_remote(catalog: DataFrame, value: bool) -> DataFrame:
    """Rows with this remote flag."""
    return apply_filters(catalog, {"remote_testing": value})


def filter_adaptive(catalog: DataFrame, value: bool) -> DataFrame:
    """Rows with this adaptive flag."""
    return apply_filters(catalog, {"adaptive": value})


def filter_duration_max(catalog: DataFrame, most: int) -> DataFrame:
    """Rows with a duration of at most so many minutes."""
    return apply_filters(catalog, {"duration_max": most})


def _kind() -> Column:
    """The filter columns of an item as one text."""
    return F.to_json(F.struct(*META))


def _filter_sets(table: QueryTable) -> DataFrame:
    """(filter_no, filters): the distinct filter sets of the queries, numbered."""
    sets = table.rows.select("filters").where(F.col("filters").isNotNull()).distinct()
    return materialize(sets.withColumn("filter_no", F.monotonically_increasing_id()))


def _passing(kinds: DataFrame, sets: DataFrame, table: QueryTable) -> DataFrame:
    """(kind, filter_no): which kinds of items meet which filter sets.

    An equi-join on the type codes; sets and kinds meet under ``_ANY`` if the set wants
    no code.
    """
    wanted = sets.withColumn("code", F.explode(F.coalesce("filters.test_type", F.array(F.lit(_ANY)))))
    codes = F.array_distinct(F.concat(F.coalesce("test_types", F.array().cast("array<string>")), F.array(F.lit(_ANY))))
    had = kinds.withColumn("code", F.explode(codes))
    passes = permits(F.col("filters"), {n: F.col(n) for n in META})
    return had.join(table.send(wanted), "code").where(passes).select("kind", "filter_no").distinct()


def _numbered_queries(table: QueryTable, sets: DataFrame) -> DataFrame:
    same = F.to_json(F.col("filters"))
    numbers = sets.select(same.alias("_set"), "filter_no")
    return table.rows.withColumn("_set", same).join(table.send(numbers), "_set", "left").drop("_set", "filters")


def numbered(items: DataFrame, table: QueryTable) -> tuple[DataFrame, QueryTable]:
    """Items with ``allowed`` (numbers of the filter sets they meet), queries with ``filter_no``.

    The rules are evaluated once per kind of item, that is, per distinct set of filter
    columns, and filter set. Queries without filters have no number.
    """
    if not table.n_filtered:
        rows = table.rows.withColumn("filter_no", F.lit(None).cast("long")).drop("filters")
        return items.withColumn("allowed", F.array().cast("array<long>")), table.having(rows)
    sets = _filter_sets(table)
    kinds = items.select(_kind().alias("kind"), *META).distinct()
    allowed = _passing(kinds, sets, table).groupBy("kind").agg(F.collect_list("filter_no").alias("allowed"))
    allowed = sent_if_few(materialize(allowed), MAX_SENT_KINDS, MAX_SENT_BYTES)
    marked = items.withColumn("kind", _kind()).join(allowed, "kind", "left").drop("kind")
    return marked, table.having(_numbered_queries(table, sets))


def count_eligible(items: DataFrame, table: QueryTable) -> DataFrame:
    """(query_id, n_eligible): items that meet the filters of each query.

    Items are counted by kind, kinds summed by filter set.
    """
    sets = _filter_sets(table)
    counted = items.groupBy(*META).agg(F.count(F.lit(1)).alias("n"))
    kinds = materialize(counted.withColumn("kind", _kind()))
    sums = _passing(kinds, sets, table).join(kinds.select("kind", "n"), "kind")
    sums = sums.groupBy("filter_no").agg(F.sum("n").alias("n_set"))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rows = _numbered_queries(table, sets).select("query_id", "filter_no").join(table.send(sums), "filter_no", "left")
    every = F.when(F.col("filter_no").isNull(), total.select("n").scalar()).otherwise(F.coalesce("n_set", F.lit(0)))
    return rows.select("query_id", every.alias("n_eligible"))


def eligible_counts(queries: DataFrame, items: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(query_id, n_eligible): items that meet the filter set of each query.

    A filter set is evaluated once per block of items, however many queries have it.
    """
    return count_eligible(items, query_table(queries, limits))
