"""Text functions against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shortlist import constants as C
from shortlist.functions import dialogue
from shortlist.functions.text import fold, strip, terms
from shortlist.operators.index import term_counts
from workload.views import PHRASES

SAMPLES = [
    "",
    "the",
    "Testing tested tests, classes and studies by the boss; TESTING!",
    "Éa éa 12 x2 été's passing glass as is",
    "word " * 300 + "other words wording",
]


def plain_terms(text: str) -> list[str]:
    found = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        if w in C.STOP_WORDS:
            continue
        if w.endswith("ing") and len(w) >= 6:
            w = w[:-3]
        elif w.endswith("ed") and len(w) >= 5:
            w = w[:-2]
        elif w.endswith("ies") and len(w) >= 5:
            w = w[:-2]
        elif w.endswith("ss"):
            pass
        elif w.endswith("s") and len(w) >= 4:
            w = w[:-1]
        found.append(w)
    return found


def test_terms_and_counts(spark):
    rows = spark.createDataFrame(list(enumerate(SAMPLES)), "id long, text string")
    for row in rows.select("id", terms(F.col("text")).alias("t")).collect():
        assert row.t == plain_terms(SAMPLES[row.id])
    for row in term_counts(rows, F.col("text")).collect():
        expected = Counter(plain_terms(SAMPLES[row.id]))
        assert {t.term: t.tf for t in row.terms} == expected
        assert row.length == sum(expected.values())


def test_strip(spark):
    texts = ["", "  a ", "\t\n a b \r\n", "a"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(strip(F.col("t"))).collect()] == [t.strip() for t in texts]


NEAR = [
    "ésue", "sue é", "jokeé", "vs", "vs.", "pay scale", "pay\nscale", "a\rjoke", "between a\nand b",
    "between a and b", "c++ developer", "c++x", "only—adaptive", "That’s it", "let's go", "GO AHEAD", "yes!! ", "yes but",
    "managers", "front-line manager", "entry level", "entry_level", "under 20 min", "under ٢٠ min", "within 5minutes",
]


@pytest.mark.parametrize(
    "patterns",
    [
        C.REFUSE_PATTERNS,
        C.COMPARE_PATTERNS,
        C.REFINE_PATTERNS,
        C.CONFIRM_PATTERNS,
        *[(p,) for p in C.CONTEXT_SIGNALS],
        *[(p,) for _, p in C.LEVEL_RULES],
        (C.ADAPTIVE_PATTERN,),
    ],
)
def test_patterns_match_as_in_python(spark, patterns):
    texts = [t.lower().strip() for t in (*PHRASES, *NEAR)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {
        r.i: r.hit
        for r in rows.select("i", dialogue.matches_any(fold(F.col("t")), patterns).alias("hit")).collect()
    }
    for i, text in enumerate(texts):
        assert got[i] == any(re.search(p, text) for p in patterns), text


def test_duration_limit(spark):
    cases = {"under 30 minutes": 30, "less  than 5 min": 5, "maximum 7 min, under 3 min": 7, "30 minutes": None, "within 99999999999 min": None}
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.n for r in rows.select("t", dialogue.duration_limit(fold(F.col("t"))).alias("n")).collect()}
    assert got == cases
