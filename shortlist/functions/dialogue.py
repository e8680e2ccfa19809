"""Column expressions that read a conversation.

Functions on ``messages`` take an array of (turn, role, content) of any length;
functions on text take one string column. Patterns expect a folded text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlist import constants as C
from shortlist.functions.text import contains_any, matches_any


def user_texts(messages: Column) -> Column:
    """Texts of the user turns, in order."""
    mine = F.filter(messages, lambda m: m["role"] == "user")
    return F.transform(mine, lambda m: F.coalesce(m["content"], F.lit("")))


def prior_marker(text: Column, site: Sequence[str] = ()) -> Column:
    """Whether an assistant text looks like an earlier recommendation."""
    return contains_any(F.lower(text), (*C.PRIOR_MARKERS, *site))


def has_prior(messages: Column, site: Sequence[str] = ()) -> Column:
    """Whether any assistant message carries a recommendation mark."""
    return F.exists(
        messages,
        lambda m: (m["role"] == "assistant")
        & F.coalesce(prior_marker(m["content"], site), F.lit(False)),
    )


def refuse_flag(folded: Column) -> Column:
    """Off-topic or instruction-override request."""
    return matches_any(folded, C.REFUSE_PATTERNS)


def compare_flag(folded: Column) -> Column:
    """Question about differences between items."""
    return matches_any(folded, C.COMPARE_PATTERNS)


def refine_flag(folded: Column) -> Column:
    """Change of earlier constraints."""
    return matches_any(folded, C.REFINE_PATTERNS)


def confirm_flag(folded: Column) -> Column:
    """Agreement with what was proposed."""
    return matches_any(folded, C.CONFIRM_PATTERNS)


def context_score(folded: Column) -> Column:
    """Number of signal groups (0 to 8) found in the whole user context."""
    hits = [folded.rlike(p).cast("int") for p in C.CONTEXT_SIGNALS]
    return sum(hits[1:], hits[0])


def job_levels(folded: Column) -> Column:
    """Levels named in the context, in rule order; NULL if none."""
    named = F.array_compact(
        F.array(*[F.when(folded.rlike(p), F.lit(level)) for level, p in C.LEVEL_RULES])
    )
    return F.when(F.size(named) > 0, named)


def wants_adaptive(folded: Column) -> Column:
    """True where adaptive tests are asked for, else NULL."""
    return F.when(folded.rlike(C.ADAPTIVE_PATTERN), F.lit(True))


def duration_limit(folded: Column) -> Column:
    """Minutes of the first upper bound on the duration, else NULL."""
    return F.regexp_extract(folded, C.DURATION_PATTERN, 1).try_cast("int")


def filters(folded: Column) -> Column:
    """Filter struct from the context; types and remote use are never set."""
    return F.struct(
        F.lit(None).cast("array<string>").alias("test_type"),
        job_levels(folded).alias("job_level"),
        F.lit(None).cast("boolean").alias("remote_testing"),
        wants_adaptive(folded).alias("adaptive"),
        duration_limit(folded).alias("duration_max"),
    )


def search_query(texts: Column) -> Column:
    """User texts joined by blanks, the last one twice if there are several."""
    joined = F.array_join(texts, " ")
    return F.when(F.size(texts) > 1, F.concat_ws(" ", joined, F.element_at(texts, -1))).otherwise(joined)


def intent(
    latest: Column,
    refuse: Column,
    compare: Column,
    refine: Column,
    confirm: Column,
    prior: Column,
    score: Column,
    n_messages: Column,
    n_user: Column,
) -> Column:
    """Intent of a conversation; the first rule that holds decides."""
    enough = score >= F.when(n_user <= 1, 3).otherwise(2)
    answered = (n_messages >= 3) & ~prior & (score >= 1)
    return (
        F.when(F.coalesce(latest, F.lit("")) == "", C.CLARIFY)
        .when(refuse, C.REFUSE)
        .when(compare, C.COMPARE)
        .when(prior & refine, C.REFINE)
        .when(answered | enough | (prior & confirm), C.RECOMMEND)
        .otherwise(C.CLARIFY)
    )
