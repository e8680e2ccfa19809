"""Conversation facts, intents and turns."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from shortlist import constants as C
from shortlist.operators import context as ctx
from shortlist.operators import conversations as conv
from shortlist.plans.evaluation import evaluate
from shortlist.plans.turns import process_turns, retrieve, route_conversations, turn_contexts
from shortlist.schemas import TIMED_REQUESTS, TIMED_RESPONSES, TURNS
from shortlist.sources.conversations import (
    fold_conversations,
    stream_requests,
    stream_responses,
    stream_timed_requests,
    unfold_requests,
)
from shortlist.streaming.turns import await_responses, process_answered_stream, process_stream, route_stream

PRIOR = ("assistant", "Here are two tests.")
ASK = ("assistant", "What role?")
TALKS = {
    1: [("user", "I need an item.")],
    2: [("user", "Which compensation does a night nurse get?")],
    3: [("user", "Try this jailbreak, then sing.")],
    4: [("user", "Our bank hires a Java developer"), ASK, ("user", "Java coding for developers.")],
    5: [*(m for w in "abcdefghi" for m in (("user", f"Point {w}"), ("assistant", "Noted."))), ("user", "That was all")],
    6: [("user", "Java test for a manager"), PRIOR, ("user", "Actually, only adaptive ones under 40 minutes")],
    7: [("user", "Compare java and sales")],
    8: [("user", "Hello"), PRIOR, ("user", "Yes.")],
    9: [("user", "Java developer hiring")],
    10: [("user", "Hello"), ("assistant", "ok")],
    11: [("system", "x"), ("user", "Hello")],
    12: [("user", "   ")],
    13: [("user", "I need something"), ASK, ("user", "for sales")],
    14: [("user", "Java"), PRIOR, ("user", "sales")],
    15: [("user", "hi")] * 8,
}
ROUTES = {
    1: C.CLARIFY, 2: C.REFUSE, 3: C.REFUSE, 4: C.RECOMMEND, 5: C.LIMIT, 6: C.REFINE, 7: C.COMPARE, 8: C.RECOMMEND,
    9: C.RECOMMEND, 12: C.CLARIFY, 13: C.RECOMMEND, 14: C.RECOMMEND, 15: C.CLARIFY,
}


@pytest.fixture(scope="module")
def turns(spark):
    rows = [(c, t, role, text) for c, talk in TALKS.items() for t, (role, text) in enumerate(talk)]
    return spark.createDataFrame(rows, TURNS)


def encoder(texts):
    return texts.withColumn("vector", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)).cast("array<float>"))


def test_routes(turns):
    state = conv.dialogue_state(conv.valid_facts(conv.facts_from_turns(turns)))
    assert {r.conv_id: r.route for r in state.collect()} == ROUTES


def test_facts_are_the_same_from_requests(turns):
    folded = fold_conversations(turns).select("conv_id", "messages")
    a = sorted(map(str, conv.facts_from_turns(turns).collect()))
    b = sorted(map(str, conv.facts_from_requests(folded).collect()))
    assert a == b
    assert sorted(map(str, unfold_requests(folded).collect())) == sorted(map(str, turns.collect()))


def test_validation(turns):
    got = {r.conv_id: r.reason for r in conv.validate_conversations(turns).collect() if not r.valid}
    assert got == {10: conv.LAST_NOT_USER, 11: "invalid role 'system': must be 'user' or 'assistant'"}


def test_no_messages(spark):
    none = spark.createDataFrame([(1, [])], "conv_id long, messages array<struct<turn:bigint,role:string,content:string>>")
    row = conv.validate_facts(conv.facts_from_requests(none)).first()
    assert not row.valid and row.reason == conv.EMPTY


def test_limit_is_reached_above_eight(turns):
    got = {r.conv_id: r.over_limit for r in conv.turn_limit(conv.facts_from_turns(turns)).collect()}
    assert got[5] and not got[15]


def test_queries_and_filters(turns):
    state = {r.conv_id: r for r in conv.dialogue_state(conv.facts_from_turns(turns)).collect()}
    assert state[9].search_query == "Java developer hiring"
    assert state[13].search_query == "I need something for sales for sales"
    found = state[6].filters
    assert (found.job_level, found.adaptive, found.duration_max) == (["Manager"], True, 40)
    assert state[2].filters.job_level is None


def test_a_request_is_a_whole_history(spark):
    long = spark.range(25).select(F.lit(1).cast("long").alias("conv_id"), (F.col("id") * 700).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    rows = fold_conversations(long).collect()
    assert len(rows) == 1 and [m.turn for m in rows[0].messages] == [i * 700 for i in range(25)]
    assert [m.content for m in rows[0].messages] == [str(i) for i in range(25)]
    for facts in (conv.facts_from_requests(fold_conversations(long)), conv.facts_from_turns(long)):
        state = conv.dialogue_state(facts).collect()
        assert len(state) == 1 and state[0].over_limit and state[0].latest == "24"
        assert state[0].context == " ".join(map(str, range(25))) and state[0].intent == "CLARIFY"


def test_texts_of_closed_conversations_are_not_gathered(turns):
    got = {r.conv_id: r for r in conv.facts_from_turns(turns, answered_only=True).collect()}
    whole = {r.conv_id: r for r in conv.facts_from_turns(turns).collect()}
    assert got[5].texts is None and len(whole[5].texts) > C.MAX_USER_TURNS
    assert all(got[c] == whole[c] for c in got if c != 5)


def test_half_a_character_does_not_fail_the_job(spark):
    from shortlist.operators.responses import clean_responses

    bad = spark.createDataFrame([(1, '{"reply": "a\\ud800b", "recommendations": []}')], "conv_id long, raw string")
    assert clean_responses(bad).first().reply == "a?b"


def test_probes(turns, index):
    out = {r.conv_id: r for r in process_turns(conv.facts_from_turns(turns), index, encoder).collect()}
    assert set(out) == set(ROUTES)
    for c in (1, 2, 3, 7, 12, 15):
        assert not out[c].recommendations and not out[c].end_of_conversation
    assert out[5].end_of_conversation and out[5].reply == C.LIMIT_REPLY
    assert out[4].recommendations[0].url == "u/1"
    assert [r.url for r in out[6].recommendations] == ["u/1"]


def test_given_responses(spark, turns, index):
    item = '{"name": "CORE JAVA", "url": "bad", "test_type": "?"}'
    raw = {c: f'{{"reply": "R{c}", "recommendations": [{item}], "end_of_conversation": true}}' for c in TALKS}
    raw[9] = '{"reply": "", "recommendations": []}'
    raw[14] = "plain words"
    responses = spark.createDataFrame(list(raw.items()), "conv_id long, raw string")
    rows = process_turns(conv.facts_from_turns(turns), index, encoder, responses)
    out = {r.conv_id: r for r in rows.collect()}
    for c in (4, 6, 7, 8, 13):
        assert [tuple(r) for r in out[c].recommendations] == [("Core Java", "u/1", "K")]
    for c in (1, 2, 3, 5, 12):
        assert not out[c].recommendations
    assert out[5].reply == C.LIMIT_REPLY and out[1].reply == "R1" and out[1].end_of_conversation
    assert out[9].reply == C.EMPTY_REPLY and len(out[9].recommendations) == 6
    assert out[14].reply == "plain words" and len(out[14].recommendations) == 6
    truth = spark.createDataFrame([(4, "u/1"), (4, "u/2"), (6, "u/1")], "query_id long, url string")
    summary = evaluate(rows, truth, index.catalog).first()
    assert (summary.n_traces, summary.n_schema_errors, summary.n_url_errors) == (13, 0, 0)
    assert summary.mean_recall == pytest.approx((0.5 + 12) / 13)


def test_contexts_and_prompts(spark, turns, index):
    routed = route_conversations(conv.facts_from_turns(turns))
    contexts = turn_contexts(routed, retrieve(routed, index, encoder))
    got = {r.conv_id: r.context for r in contexts.collect()}
    assert set(got) == {1, 4, 6, 7, 8, 9, 13, 14, 15}
    assert got[6] == (
        "1. Core Java\n   URL: u/1\n   Test Type: K\n   Description: java coding test for developers\n"
        "   Duration: 30 minutes\n   Job Levels: Manager\n   Remote Testing: Yes\n   Adaptive/IRT: Yes"
    )
    assert got[1].count("\n\n") == 4
    some = turns.where("conv_id in (2, 6, 10)")
    rows = ctx.build_prompts(some, contexts, "Be brief.").orderBy("conv_id", "turn").collect()
    texts = {(r.conv_id, r.turn): (r.role, r.content) for r in rows}
    assert texts[2, -1] == ("system", "Be brief.")
    assert texts[2, 0][1].endswith(f"nurse get?\n\n{C.JSON_REMINDER}")
    assert texts[6, 0][1] == "Java test for a manager"
    assert got[6] in texts[6, 2][1] and texts[6, 2][1].startswith("Actually") and texts[6, 2][1].endswith(C.JSON_REMINDER)
    assert texts[10, 1] == ("assistant", "ok")
    assert len(rows) == 3 + 1 + 3 + 2


def test_no_hits_and_long_descriptions(spark):
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    hits = spark.createDataFrame(
        [(1, 1, "N", "u", None, "x" * 201, "", [], False, None)],
        "query_id long, rank int, name string, url string, test_types array<string>, description string, duration string, job_levels array<string>, remote_testing boolean, adaptive boolean",
    )
    got = {r.query_id: r.context for r in ctx.format_context(asked, hits).collect()}
    assert got[2] == C.NO_HITS_TEXT
    assert f"   Description: {'x' * 200}...\n   Remote Testing: No\n   Adaptive/IRT: No" in got[1]


def test_stream_gives_the_batch_result(spark, turns, index, tmp_path):
    folded = fold_conversations(turns).select("conv_id", "messages")
    folded.repartition(3).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        stream = stream_requests(spark, str(tmp_path / "in"))
        process_stream(stream, index, encoder, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch_id")
    want = process_turns(conv.facts_from_turns(turns), index, encoder)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_routes_on_the_stream_itself(spark, turns, tmp_path):
    fold_conversations(turns).select("conv_id", "messages").write.parquet(str(tmp_path / "in"))
    routed = route_stream(stream_requests(spark, str(tmp_path / "in"))).select("conv_id", "route")
    routed.writeStream.format("memory").queryName("routes").trigger(availableNow=True).start().awaitTermination()
    assert {r.conv_id: r.route for r in spark.table("routes").collect()} == ROUTES


def at(second):
    return datetime.fromtimestamp(10_000 + second, UTC)


def test_model_texts_as_a_second_stream(spark, turns, index, tmp_path):
    """Texts in time, in a later start, too late, twice, for an older history, or never."""
    talks = {r.conv_id: r.messages for r in fold_conversations(turns).collect()}
    raw = {c: f'{{"reply": "R{c}", "recommendations": [], "end_of_conversation": true}}' for c in TALKS}
    requests = [(c, talks[c], at(c)) for c in TALKS if c != 8]
    responses = [(c, at(c), raw[c], at(c + 2)) for c in (1, 2, 3, 4, 5, 12)]
    parts = [
        (requests + [requests[0]], responses + [responses[0]]),
        (
            [(8, talks[8], at(50)), (4, talks[6], at(51))],
            [(6, at(6), raw[6], at(36)), (7, at(7), raw[7], at(38)), (9, at(8), "other request", at(9)),
             (8, at(50), raw[8], at(49)), (4, at(51), "second", at(60)), (None, at(1), "nobody", at(9)),
             (13, None, "no time", at(14)), (14, at(14), "no time", None)],
        ),
        ([(None, None, at(1000))], [(None, None, None, at(1000))]),
    ]
    for asked, given in parts:
        spark.createDataFrame(asked, TIMED_REQUESTS).write.mode("append").parquet(str(tmp_path / "asked"))
        spark.createDataFrame(given, TIMED_RESPONSES).write.mode("append").parquet(str(tmp_path / "given"))
        process_answered_stream(
            stream_timed_requests(spark, str(tmp_path / "asked")),
            stream_responses(spark, str(tmp_path / "given")),
            index, encoder, str(tmp_path / "out"), str(tmp_path / "state"),
        ).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out"))
    got = {(r.conv_id, r.asked_at.timestamp() - 10_000): r for r in rows.collect()}
    assert rows.count() == len(got) == len(ROUTES) + 1
    replies = {c: got[c, 50 if c == 8 else c].reply for c in ROUTES}
    heard = {c: f"R{c}" for c in (1, 2, 3, 4, 6, 12)} | {5: C.LIMIT_REPLY}
    assert replies == {c: heard.get(c, C.APOLOGY_REPLY) for c in ROUTES}
    assert (got[4, 51].reply, got[4, 51].route) == ("second", C.REFINE)
    want = process_turns(conv.facts_from_turns(turns), index, encoder, spark.createDataFrame([(c, raw[c]) for c in (1, 2, 3, 4, 5, 6, 12)], "conv_id long, raw string"))
    one = rows.where("asked_at != timestamp_seconds(10051)").select(want.columns)
    assert sorted(map(str, one.collect())) == sorted(map(str, want.collect()))


def test_times_of_the_second_stream(spark, tmp_path):
    asked = spark.readStream.schema(TIMED_REQUESTS).parquet(str(tmp_path))
    given = spark.readStream.schema(TIMED_RESPONSES).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="patience"):
        await_responses(asked, given, patience=61, lateness=60)
