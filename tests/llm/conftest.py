"""The shared session of the other tests, and small tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import ODD  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, start string"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text) rows, with extra columns whose names clash."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t), "x", "y", "z") for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)
