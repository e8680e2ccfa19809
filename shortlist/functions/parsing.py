"""Strict JSON check of candidate texts; the only Python in response cleaning."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOUND = T.StructType(
    [T.StructField("attempt", T.IntegerType()), T.StructField("parsed", T.StringType())]
)


def _canonical(text: str | None) -> str | None:
    """The JSON value of a text, rewritten plainly; None if it is not JSON."""
    if text is None:
        return None
    try:
        value = json.dumps(json.loads(text, parse_constant=lambda _: None), ensure_ascii=False)
        # An escaped half of a pair is no character; it becomes a question mark.
        return value.encode("utf-8", "replace").decode("utf-8")
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(FOUND)
def first_json(candidates: pd.Series) -> pd.DataFrame:
    """Number (from 1) and canonical text of the first candidate that is JSON."""

    def pick(texts):
        for number, text in enumerate(texts, 1):
            value = _canonical(text)
            if value is not None:
                return number, value
        return None, None

    found = pd.DataFrame([pick(t) for t in candidates], columns=["attempt", "parsed"])
    return found.astype({"attempt": "Int32", "parsed": object})
