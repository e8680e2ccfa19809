"""Text columns: white space, word-boundary folding, terms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist.constants import STOP_WORDS

_EDGE_SPACE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
_WORD = r"[\p{L}\p{N}]+"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` knows blanks only)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def fold(text: Column) -> Column:
    """Lower-case ASCII image of a text with the same word boundaries.

    Other white space becomes a blank, foreign letters become ``_`` (a word
    character) and foreign signs ``|`` (no word character), so ASCII patterns
    see accented words as whole words.
    """
    blanks = F.regexp_replace(F.lower(text), r"[\p{Z}\r]", " ")
    signs = F.regexp_replace(blanks, r"[^\x00-\x7F\p{L}\p{N}]", "|")
    return F.regexp_replace(signs, r"[^\x00-\x7F]", "_")


def matches_any(folded: Column, patterns: tuple[str, ...]) -> Column:
    """True where any of the patterns is found."""
    return folded.rlike("|".join(f"(?:{p})" for p in patterns))


def contains_any(text: Column, parts: tuple[str, ...]) -> Column:
    """True where any of the parts occurs."""
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def stem(term: Column) -> Column:
    """Cut plural, -ing and -ed endings of terms that stay long enough."""
    size = F.length(term)

    def cut(ending: str, least: int, drop: int) -> tuple[Column, Column]:
        return term.endswith(ending) & (size >= least), F.substring(term, F.lit(1), size - drop)

    rules = [cut("ing", 6, 3), cut("ed", 5, 2), cut("ies", 5, 2), cut("ss", 0, 0), cut("s", 4, 1)]
    (condition, value), *rest = rules
    chain = F.when(condition, value)
    for condition, value in rest:
        chain = chain.when(condition, value)
    return chain.otherwise(term)


def terms(text: Column) -> Column:
    """Stemmed terms of a text without stop words, in order, with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
    return F.transform(kept, stem)


def run_starts(ordered: Column) -> Column:
    """Positions in a sorted array at which a new value begins."""
    return F.array_compact(
        F.transform(
            ordered,
            lambda x, i: F.when((i == 0) | (x != F.get(ordered, i - 1)), i),
        )
    )


def run_lengths(ordered: Column, starts: Column) -> Column:
    """Term counts of a sorted array: array of (term, tf)."""
    return F.transform(
        starts,
        lambda s, j: F.struct(
            F.get(ordered, s).alias("term"),
            (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - s).alias("tf"),
        ),
    )
