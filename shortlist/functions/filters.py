"""Predicates on catalog metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes(duration: Column) -> Column:
    """All digits of a duration text as one integer, NULL where there is none."""
    return F.regexp_replace(duration, "[^0-9]", "").try_cast("int")


def overlaps(values: Column, wanted: Column) -> Column:
    """Whether two arrays share a value; NULL arrays share nothing."""
    return F.coalesce(F.arrays_overlap(values, wanted), F.lit(False))


def permits(filters: Column, row: dict[str, Column]) -> Column:
    """Whether a catalog row meets a filter struct; NULL fields do not constrain.

    ``row`` gives the columns ``test_types job_levels remote_testing adaptive
    minutes`` of the catalog side.
    """
    tests = {
        "test_type": lambda v: overlaps(row["test_types"], v),
        "job_level": lambda v: overlaps(row["job_levels"], v),
        "remote_testing": lambda v: F.coalesce(row["remote_testing"] == v, F.lit(False)),
        "adaptive": lambda v: F.coalesce(row["adaptive"] == v, F.lit(False)),
        "duration_max": lambda v: F.coalesce(row["minutes"] <= v, F.lit(False)),
    }
    parts = [filters[k].isNull() | test(filters[k]) for k, test in tests.items()]
    return reduce(lambda a, b: a & b, parts)
