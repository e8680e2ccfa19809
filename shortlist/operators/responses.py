"""Recover, normalise and emit responses from a table of raw model texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist import constants as C
from shortlist.functions.parsing import first_json
from shortlist.functions.text import strip
from shortlist.schemas import RECOMMENDATION

# Patterns of the four attempts, JSON texts of the values that count as false.
_FENCED = r"(?s)```(?:json)?\s*\n?(.*?)\n?```"
_BRACED = r"(?s)\{.*\}"
_COMMA = r",\s*([}\]])"
_FALSE = ("false", "null", "0", "-0", "0.0", "-0.0", '""', "[]", "{}")


def recover_json(responses: DataFrame) -> DataFrame:
    """Adds ``attempt`` and ``parsed`` (canonical JSON text) to (conv_id, raw).

    Attempts: the whole text, a fenced block, first to last brace, and the text
    with double quotes for single ones and without trailing commas.
    """
    text = strip(F.col("raw"))
    fenced = F.when(text.rlike(_FENCED), strip(F.regexp_extract(text, _FENCED, 1)))
    braced = F.when(text.rlike(_BRACED), F.regexp_extract(text, _BRACED, 0))
    mended = F.regexp_replace(F.replace(text, F.lit("'"), F.lit('"')), _COMMA, "$1")
    found = responses.withColumn("_found", first_json(F.array(text, fenced, braced, mended)))
    return found.select(*responses.columns, "_found.attempt", "_found.parsed")


def _value(v: Column, key: str) -> Column:
    """Value of a key as a variant; NULL if it is missing or null."""
    value = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(~F.is_variant_null(value), value)


def _either(v: Column, key: str, other: str) -> Column:
    return F.coalesce(_value(v, key), _value(v, other))


def _true(value: Column) -> Column:
    """Whether a value counts as true; texts do unless they are empty."""
    return F.coalesce(~F.to_json(value).isin(*_FALSE), F.lit(False))


def _text(value: Column) -> Column:
    """A value as text: strings as they are, lists with their strings in quotes, objects as JSON."""
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), _quoted)
    listed = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    return F.when(F.schema_of_variant(value).startswith("ARRAY"), listed).otherwise(_plain(value))


def _plain(value: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.initcap(text)).otherwise(text)


def _quoted(item: Column) -> Column:
    """An item of a list: a string in quotes (double ones if it holds single ones only)."""
    text = F.try_variant_get(item, "$", "string")
    mark = F.when(text.contains("'") & ~text.contains('"'), F.lit('"')).otherwise(F.lit("'"))
    return (
        F.when(F.is_variant_null(item), F.lit("None"))
        .when(F.schema_of_variant(item) == "STRING", F.concat(mark, text, mark))
        .otherwise(_plain(item))
    )


def _item(v: Column) -> Column:
    return F.struct(
        _text(_value(v, "name")).alias("name"),
        _text(_value(v, "url")).alias("url"),
        F.coalesce(_text(_either(v, "test_type", "test_types")), F.lit("")).alias("test_type"),
    ).cast(RECOMMENDATION)


def normalize_response(parsed: DataFrame) -> DataFrame:
    """Adds ``is_object``, ``reply``, ``recommendations``, ``end_of_conversation``.

    Alternative keys are read where the first is missing or null; items need a
    name and a url; at most ``MAX_RECOMMENDATIONS`` are kept. An object whose
    recommendations are a number or a truth value counts as no object.
    """
    rows = parsed.withColumn("_v", F.try_parse_json("parsed"))
    v = F.col("_v")
    given = _either(v, "recommendations", "assessments")
    rows = rows.withColumn("_items", F.try_variant_get(given, "$", "array<variant>"))
    countable = F.coalesce(F.schema_of_variant(given).rlike("^(ARRAY|OBJECT|STRING)"), F.lit(True))
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    whole = F.filter("_items", lambda x: _true(_value(x, "name")) & _true(_value(x, "url")))
    none = F.array().cast(f"array<{RECOMMENDATION.simpleString()}>")
    kept = F.slice(F.transform(whole, _item), 1, C.MAX_RECOMMENDATIONS)
    return rows.withColumns(
        {
            "is_object": is_object & countable,
            "reply": F.coalesce(_text(_either(v, "reply", "response")), F.lit("")),
            "recommendations": F.coalesce(kept, none),
            "end_of_conversation": F.coalesce(_true(_either(v, "end_of_conversation", "end")), F.lit(False)),
        }
    ).drop("_v", "_items")


def with_fallback(normalized: DataFrame) -> DataFrame:
    """(conv_id, reply, recommendations, end_of_conversation) that can be shown.

    No text at all, or JSON that is no object: apology. No JSON: the text itself.
    Empty reply: the default question.
    """
    failed = F.col("raw").isNull() | (F.col("parsed").isNotNull() & ~F.col("is_object"))
    usable = F.coalesce(F.col("is_object"), F.lit(False))
    none = F.array().cast(f"array<{RECOMMENDATION.simpleString()}>")
    return normalized.select(
        "conv_id",
        F.when(failed, C.APOLOGY_REPLY)
        .when(F.col("parsed").isNull(), strip(F.col("raw")))
        .when(F.col("reply") == "", C.EMPTY_REPLY)
        .otherwise(F.col("reply"))
        .alias("reply"),
        F.when(usable, F.col("recommendations")).otherwise(none).alias("recommendations"),
        F.when(usable, F.col("end_of_conversation")).otherwise(F.lit(False)).alias("end_of_conversation"),
    )


def clean_responses(responses: DataFrame) -> DataFrame:
    """From (conv_id, raw) to showable responses."""
    return with_fallback(normalize_response(recover_json(responses)))


def to_responses(rows: DataFrame) -> DataFrame:
    """(conv_id, response): the response as one JSON text per row."""
    body = F.struct("reply", "recommendations", "end_of_conversation")
    return rows.select("conv_id", F.to_json(body).alias("response"))


def write_responses(rows: DataFrame, path: str) -> None:
    """Store responses as JSON lines."""
    rows.write.mode("overwrite").json(path)
