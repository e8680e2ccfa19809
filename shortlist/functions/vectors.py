"""Vector columns over ``array<float>`` or ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(
        F.arrays_zip(v.alias("x"), F.array_repeat(norm(v), F.size(v)).alias("n")),
        lambda p: F.when(p["n"] > 0, p["x"].cast("double") / p["n"]).otherwise(p["x"].cast("double")),
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, not clamped; NULL if a vector is missing or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
