"""One turn for every conversation of a batch: route, search, answer, repair."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist import constants as C
from shortlist.operators.context import format_context
from shortlist.operators.conversations import dialogue_state, valid_facts
from shortlist.operators.hybrid import search_hybrid, with_details
from shortlist.operators.index import CatalogIndex
from shortlist.operators.lookup import repair_recommendations
from shortlist.operators.queries import Limits
from shortlist.operators.responses import clean_responses
from shortlist.schemas import FILTERS, RECOMMENDATION
from shortlist.session import at_most, materialize
from shortlist.sources.catalog import coerce_nulls, type_codes

Encoder = Callable[[DataFrame], DataFrame]
_NO_ITEMS = f"array<{RECOMMENDATION.simpleString()}>"
_FILTERED = (C.RECOMMEND, C.REFINE)


def route_conversations(facts: DataFrame) -> DataFrame:
    """Dialogue state of the valid conversations, computed once."""
    kept = ("conv_id", "route", "search_query", "filters")
    return materialize(dialogue_state(valid_facts(facts)).select(*kept))


def retrieval_queries(routed: DataFrame) -> DataFrame:
    """(query_id, text, filters, k) of the conversations that search.

    Recommending and refining search with filters, comparing without; clarifying
    looks at a few items if there is enough text; refusing does not search.
    """
    route, text = F.col("route"), F.col("search_query")
    clarify = (route == C.CLARIFY) & (F.length(text) > C.CLARIFY_MIN_QUERY_CHARS)
    searching = route.isin(*_FILTERED, C.COMPARE) | clarify
    return routed.where(searching).select(
        F.col("conv_id").alias("query_id"),
        text.alias("text"),
        F.when(route.isin(*_FILTERED), F.col("filters")).cast(FILTERS).alias("filters"),
        F.when(route == C.CLARIFY, C.CLARIFY_TOP_K).otherwise(C.RETRIEVAL_TOP_K).alias("k"),
    )


def retrieve(
    routed: DataFrame,
    index: CatalogIndex,
    encoder: Encoder,
    alpha: float | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """Ranked items, with details, of every conversation that searches."""
    # Stored, as the search reads its queries several times: each text is encoded once.
    queries = materialize(encoder(retrieval_queries(routed)))
    depth = queries.select("query_id", "k")
    found = search_hybrid(queries, index, k=C.RETRIEVAL_TOP_K, alpha=alpha, limits=limits)
    kept = found.join(depth, "query_id").where(F.col("rank") <= F.col("k")).drop("k")
    few = at_most(depth, limits.queries)
    return with_details(kept, coerce_nulls(index.catalog), few)


def turn_contexts(routed: DataFrame, items: DataFrame) -> DataFrame:
    """(conv_id, context) of the conversations that search, for the model call."""
    asked = retrieval_queries(routed)
    return format_context(asked, items).withColumnRenamed("query_id", "conv_id")


def answer_turns(
    routed: DataFrame, items: DataFrame, catalog: DataFrame, responses: DataFrame | None = None
) -> DataFrame:
    """(conv_id, route, reply, recommendations, end_of_conversation).

    ``responses`` (conv_id, raw) are the model's texts; a conversation without
    one is treated as a failed call.
    """
    if responses is None:
        cleaned = routed.select("conv_id").where(F.lit(False))
        cleaned = cleaned.withColumns(
            {
                "reply": F.lit(""),
                "recommendations": F.array().cast(_NO_ITEMS),
                "end_of_conversation": F.lit(False),
            }
        )
    else:
        asked = routed.where(F.col("route") != C.LIMIT).select("conv_id")
        cleaned = clean_responses(responses.join(asked, "conv_id", "left_semi"))
    route = F.col("route")
    none = F.array().cast(_NO_ITEMS)
    answered = routed.select("conv_id", "route").join(cleaned, "conv_id", "left").select(
        "conv_id",
        "route",
        F.when(route == C.LIMIT, C.LIMIT_REPLY)
        .otherwise(F.coalesce("reply", F.lit(C.APOLOGY_REPLY)))
        .alias("reply"),
        F.when(route.isin(*_FILTERED, C.COMPARE), F.col("recommendations")).alias("given"),
        F.when(route == C.LIMIT, True)
        .otherwise(F.coalesce("end_of_conversation", F.lit(False)))
        .alias("end_of_conversation"),
    )
    answered = materialize(answered)
    some = F.coalesce(F.size("given"), F.lit(0)) > 0
    given = answered.where(some).select("conv_id", F.col("given").alias("recommendations"))
    repaired = repair_recommendations(given, catalog) if responses is not None else given
    fallback = retrieved_recommendations(items)
    return (
        answered.join(repaired, "conv_id", "left")
        .join(fallback, "conv_id", "left")
        .select(
            "conv_id",
            "route",
            "reply",
            F.coalesce(
                "recommendations",
                F.when(route.isin(*_FILTERED) & ~some, F.col("found")),
                none,
            ).alias("recommendations"),
            "end_of_conversation",
        )
    )


def retrieved_recommendations(items: DataFrame) -> DataFrame:
    """(conv_id, found): the best items in the form of recommendations."""
    item = F.struct("name", "url", type_codes().alias("test_type")).cast(RECOMMENDATION)
    lists = (
        items.where(F.col("rank") <= C.MAX_RECOMMENDATIONS)
        .groupBy(F.col("query_id").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(F.struct("rank", item.alias("item")))).alias("items"))
    )
    return lists.select("conv_id", F.col("items")["item"].alias("found"))


def process_turns(
    facts: DataFrame,
    index: CatalogIndex,
    encoder: Encoder,
    responses: DataFrame | None = None,
    alpha: float | None = None,
    limits: Limits = Limits(),
) -> DataFrame:
    """The response to every valid conversation of a batch."""
    routed = route_conversations(facts)
    items = retrieve(routed, index, encoder, alpha, limits)
    return answer_turns(routed, items, index.catalog, responses)


def route_counts(facts: DataFrame) -> DataFrame:
    """(route, n) over the valid conversations."""
    return dialogue_state(valid_facts(facts)).groupBy("route").agg(F.count(F.lit(1)).alias("n"))
