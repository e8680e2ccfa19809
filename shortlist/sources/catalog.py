"""Reading, building and viewing the catalog table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.schemas import CATALOG

EMPTY_STRINGS = "array<string>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Scan a catalog stored as Parquet."""
    return spark.read.schema(CATALOG).parquet(path)


def ingest_catalog(
    raw: DataFrame, encoder: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Typed catalog from a table ``value`` with one JSON object per row.

    Rows that are no JSON object or have no id are left out. ``encoder`` adds a
    ``vector`` to rows with query_id and text; it fills ``embedding`` where that is
    missing (elsewhere the text is NULL). No join, no shuffle.
    """
    parsed = raw.select(F.from_json("value", CATALOG).alias("row")).select("row.*")
    typed = coerce_nulls(parsed.where(F.col("id").isNotNull()))
    if encoder is None:
        return typed
    text = F.when(F.col("embedding").isNull(), F.concat_ws(" ", "name", "description"))
    encoded = encoder(typed.withColumns({"query_id": F.col("id"), "text": text}))
    vector = F.coalesce("embedding", F.col("vector").cast("array<float>"))
    return encoded.withColumn("embedding", vector).select(*typed.columns)


def write_catalog(catalog: DataFrame, path: str) -> None:
    """Store the catalog as Parquet."""
    catalog.write.mode("overwrite").parquet(path)


def coerce_nulls(catalog: DataFrame) -> DataFrame:
    """Missing lists become empty lists, missing texts empty texts."""
    empty = F.array().cast(EMPTY_STRINGS)
    return catalog.withColumns(
        {
            "test_types": F.coalesce("test_types", empty),
            "description": F.coalesce("description", F.lit("")),
            "duration": F.coalesce("duration", F.lit("")),
            "job_levels": F.coalesce("job_levels", empty),
        }
    )


def type_codes(test_types: str = "test_types"):
    """Type codes as one text, empty where there are none."""
    return F.coalesce(F.array_join(test_types, ", "), F.lit(""))


def to_recommendation(catalog: DataFrame) -> DataFrame:
    """Short view of an item: name, url and its codes in one text."""
    return catalog.select("name", "url", type_codes().alias("test_type"))


def to_detail(catalog: DataFrame) -> DataFrame:
    """The eight descriptive columns."""
    return coerce_nulls(catalog).select(
        "name",
        "url",
        "test_types",
        "description",
        "duration",
        "job_levels",
        "remote_testing",
        "adaptive",
    )


def catalog_urls(catalog: DataFrame) -> DataFrame:
    """The set of URLs in the catalog."""
    return catalog.select("url").where(F.col("url").isNotNull()).distinct()
