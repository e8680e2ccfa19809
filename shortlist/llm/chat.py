"""Every participant's view of a dialogue, for training on multi-party talks.

For each speaker of a conversation the dialogue is rendered once with that speaker as
the assistant and all others as named users; only the assistant's words are learnt, so
each view carries the spans of its loss mask. Turns of ``SYSTEM`` belong to no
participant and are rendered as system turns in every view.

A view is cut into parts of ``PART_TURNS`` turns, in order, so no row grows with the
length of a conversation; the texts of a view's parts, one after another, are its text.
Positions in a conversation are counted by range partition, so a conversation that is
a third of the table is no single group.

Order: by turn, then role, then text; null turns first. A null role is the speaker
``unknown``; a null text is empty; a null ``conv_id`` is a conversation of its own.
Repeated rows are turns of their own. A conversation of system turns only has no
participants and gives no rows. ``<|`` in a text or name is broken up, so that no text
can pass for a header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.session import materialize

SYSTEM = "system"
PART_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>\n"


def _plain(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _positions(turns: DataFrame) -> DataFrame:
    """Adds ``at``, the place of a turn in its conversation, counted from 0."""
    order = ["conv_id", "turn", "role", "text", "tie"]
    # Equal rows are told apart by their place in the input, so they can be split too.
    rows = turns.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(
        "conv_id", "turn", "role", "text", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq")
    )
    rows = materialize(rows)
    runs = rows.groupBy("conv_id", "pid").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    before = Window.partitionBy("conv_id").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("run_conv"), F.col("pid").alias("run_pid"), "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    on = F.col("conv_id").eqNullSafe(F.col("run_conv")) & (F.col("pid") == F.col("run_pid"))
    at = F.col("seq") - F.col("first") + F.col("base")
    return rows.join(runs, on, "left").select("conv_id", "turn", "role", "text", at.alias("at"))


def perspectives(turns: DataFrame) -> DataFrame:
    """Views of all conversations: conv_id, speaker, part, n_turns, text, mask, n_learnt.

    ``mask`` lists (start, end) of the learnt characters in ``text``: what the speaker
    says, with the end mark; ``n_learnt`` counts them.
    """
    rows = turns.select(
        F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    placed = _positions(rows)
    part = F.floor(F.col("at") / PART_TURNS).cast("int")
    turn = F.struct("at", F.col("role"), _plain(F.col("text")).alias("text"))
    parts = placed.groupBy("conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    views = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("of")))

    def head(t):
        mine = F.lit(START + "assistant\n")
        named = F.concat(F.lit(START + "user name="), _plain(t["role"]), F.lit("\n"))
        return (
            F.when(t["role"] == F.col("speaker"), mine)
            .when(t["role"] == SYSTEM, F.lit(START + "system\n"))
            .otherwise(named)
        )

    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == F.col("speaker")).alias("mine"), head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body")
        ),
    )
    views = views.select("conv_id", "speaker", "part", pieces.alias("pieces"))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    # A fold over at most PART_TURNS pieces: (end so far, spans).
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["end"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
            F.when(
                p["mine"],
                F.array_append(
                    a["spans"],
                    F.struct(
                        (a["end"] + F.length(p["head"])).alias("start"),
                        (a["end"] + F.length(p["head"]) + F.length(p["body"])).alias("end"),
                    ),
                ),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
    )["spans"]
    learnt = F.aggregate(
        "pieces", F.lit(0), lambda a, p: a + F.when(p["mine"], F.length(p["body"])).otherwise(0)
    )
    return views.select(
        "conv_id", "speaker", "part", F.size("pieces").alias("n_turns"), text.alias("text"), spans.alias("mask"), learnt.alias("n_learnt")
    )
