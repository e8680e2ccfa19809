"""Conversation facts, validation and dialogue state.

Facts are one row per conversation, with the texts of all its user turns. They come
either from turn rows (counts combine before the shuffle) or from folded requests (no
shuffle at all). Answering closes a conversation over the turn limit without reading
its texts; ``answered_only`` then leaves them out before they are gathered, and
``texts`` is NULL there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist import constants as C
from shortlist.functions import dialogue
from shortlist.functions.text import fold, strip

ROLES = ("user", "assistant")
EMPTY = "at least one message is required"
LAST_NOT_USER = "the last message must be from the user"


def _bad_role(role):
    return F.concat(
        F.lit("invalid role '"), role, F.lit("': must be 'user' or 'assistant'")
    )


def facts_from_turns(
    turns: DataFrame, site: Sequence[str] = (), answered_only: bool = False
) -> DataFrame:
    """Conversation facts from turn rows."""
    role, turn = F.col("role"), F.col("turn")
    marked = F.coalesce(dialogue.prior_marker(F.col("text"), site), F.lit(False))
    counts = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.count_if(role == "user").alias("n_user"),
        F.count_if(~F.coalesce(role.isin(*ROLES), F.lit(False))).alias("n_bad_roles"),
        F.max("turn").alias("last_turn"),
        F.max(F.when(role == "user", turn)).alias("last_user_turn"),
        F.coalesce(F.max((role == "assistant") & marked), F.lit(False)).alias("prior"),
    )
    said = turns.where(role == "user").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")
    )
    read = F.lit(True)
    if answered_only:
        read = F.col("n_user") <= C.MAX_USER_TURNS
        said = said.join(counts.where(read).select("conv_id"), "conv_id", "left_semi")
    texts = (
        said.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("texts"))
    )
    return counts.join(texts, "conv_id", "left").select(
        "conv_id",
        "n_messages",
        "n_user",
        (F.col("n_bad_roles") == 0).alias("roles_ok"),
        F.coalesce(F.col("last_turn") == F.col("last_user_turn"), F.lit(False)).alias("user_last"),
        "prior",
        F.when(read, F.coalesce(F.col("texts")["text"], F.array().cast("array<string>"))).alias("texts"),
    )


def facts_from_requests(requests: DataFrame, site: Sequence[str] = ()) -> DataFrame:
    """Conversation facts from folded requests; a narrow projection."""
    messages = F.coalesce("messages", F.array().cast(requests.schema["messages"].dataType))
    texts = dialogue.user_texts(messages)
    return requests.select(
        "conv_id",
        F.size(messages).cast("long").alias("n_messages"),
        F.size(texts).cast("long").alias("n_user"),
        F.forall(messages, lambda m: F.coalesce(m["role"].isin(*ROLES), F.lit(False))).alias("roles_ok"),
        F.coalesce(F.get(messages, F.size(messages) - 1)["role"] == "user", F.lit(False)).alias("user_last"),
        dialogue.has_prior(messages, site).alias("prior"),
        texts.alias("texts"),
    )


def validate_facts(facts: DataFrame) -> DataFrame:
    """(conv_id, valid, reason) of every conversation."""
    reason = (
        F.when(F.col("n_messages") == 0, EMPTY)
        .when(~F.col("roles_ok"), "invalid role: must be 'user' or 'assistant'")
        .when(~F.col("user_last"), LAST_NOT_USER)
    )
    return facts.select("conv_id", reason.isNull().alias("valid"), reason.alias("reason"))


def validate_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, valid, reason); the reason names the first wrong role."""
    wrong = (
        turns.where(~F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))
        .groupBy("conv_id")
        .agg(F.min_by("role", "turn").alias("role"))
    )
    checked = validate_facts(facts_from_turns(turns)).join(wrong, "conv_id", "left")
    named = F.when(F.col("role").isNotNull(), _bad_role(F.col("role"))).otherwise(F.col("reason"))
    return checked.select("conv_id", "valid", named.alias("reason"))


def valid_facts(facts: DataFrame) -> DataFrame:
    """Facts of the conversations that can be processed."""
    return facts.where((F.col("n_messages") > 0) & F.col("roles_ok") & F.col("user_last"))


def latest_user_message(facts: DataFrame) -> DataFrame:
    """Adds ``latest``: last user text, lower case, stripped."""
    last = F.coalesce(F.get("texts", F.size("texts") - 1), F.lit(""))
    return facts.withColumn("latest", F.when(F.col("texts").isNotNull(), strip(F.lower(last))))


def user_context(facts: DataFrame) -> DataFrame:
    """Adds ``context``: the user texts joined by one blank."""
    return facts.withColumn("context", F.array_join("texts", " "))


def turn_limit(facts: DataFrame) -> DataFrame:
    """Adds ``over_limit``."""
    return facts.withColumn("over_limit", F.col("n_user") > C.MAX_USER_TURNS)


def message_flags(facts: DataFrame) -> DataFrame:
    """Adds the four flags of the latest user message."""
    folded = latest_user_message(facts).withColumn("latest_folded", fold(F.col("latest")))
    text = F.col("latest_folded")
    return folded.withColumns(
        {
            "refuse": dialogue.refuse_flag(text),
            "compare": dialogue.compare_flag(text),
            "refine": dialogue.refine_flag(text),
            "confirm": dialogue.confirm_flag(text),
        }
    ).drop("latest_folded")


def context_signals(facts: DataFrame) -> DataFrame:
    """Adds ``context``, ``score`` and the ``filters`` found in the context."""
    folded = user_context(facts).withColumn("context_folded", fold(F.col("context")))
    text = F.col("context_folded")
    return folded.withColumns(
        {"score": dialogue.context_score(text), "filters": dialogue.filters(text)}
    ).drop("context_folded")


def dialogue_state(facts: DataFrame) -> DataFrame:
    """All derived columns of a conversation, with ``intent`` and ``route``.

    ``route`` is the intent, or ``LIMIT`` for a conversation over the turn limit.
    """
    state = context_signals(message_flags(turn_limit(facts)))
    names = ("latest", "refuse", "compare", "refine", "confirm", "prior", "score")
    decided = dialogue.intent(*[F.col(n) for n in names], F.col("n_messages"), F.col("n_user"))
    over = F.col("over_limit")
    return state.withColumns(
        {
            "search_query": dialogue.search_query(F.col("texts")),
            "intent": decided,
            "route": F.when(over, F.lit(C.LIMIT)).otherwise(decided),
        }
    )
