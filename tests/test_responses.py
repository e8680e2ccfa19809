"""Response cleaning, ingestion and evaluation."""

from __future__ import annotations

import json

import pytest

from shortlist import constants as C
from shortlist.operators import evaluation as ev
from shortlist.operators import responses as rsp
from shortlist.sources import catalog as cat

FULL = {"reply": "Hi", "recommendations": [{"name": "A", "url": "u", "test_type": "K"}], "end_of_conversation": True}
TEXT = json.dumps(FULL)
CASES = {
    1: (TEXT, 1),
    2: (f"```json\n{TEXT}\n```", 2),
    3: (f"Well: {TEXT} Bye", 3),
    4: (TEXT.replace('"', "'"), 4),
    5: (TEXT.replace("}]", "},]"), 4),
    6: ("no json", None),
    7: ("[1, 2]", 1),
    8: ('{"a": 1} and {"b": 2}', None),
    9: (f"  {TEXT}\n", 1),
    10: (f"```\n{TEXT}```", 2),
    11: (TEXT + "x", 3),
    12: (None, None),
    13: ("", None),
}


def clean(spark, texts):
    rows = spark.createDataFrame(list(texts.items()), "conv_id long, raw string")
    return {r.conv_id: r for r in rsp.clean_responses(rows).collect()}


def test_recovery(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "conv_id long, raw string")
    got = {r.conv_id: r for r in rsp.recover_json(rows).collect()}
    for k, (text, attempt) in CASES.items():
        assert got[k].attempt == attempt, text
        if attempt and k != 7:
            assert json.loads(got[k].parsed) == FULL


def test_fallbacks(spark):
    got = clean(spark, {k: t for k, (t, _) in CASES.items()})
    for k in (1, 2, 3, 4, 5, 9, 10, 11):
        assert got[k].reply == "Hi" and got[k].end_of_conversation
        assert [tuple(r) for r in got[k].recommendations] == [("A", "u", "K")]
    assert got[6].reply == "no json" and got[8].reply == '{"a": 1} and {"b": 2}'
    assert got[7].reply == C.APOLOGY_REPLY and got[12].reply == C.APOLOGY_REPLY
    assert not got[6].recommendations and not got[7].end_of_conversation


@pytest.mark.parametrize(
    "body, reply, urls, end",
    [
        ({"response": "x", "assessments": [{"name": "A", "url": "u"}], "end": 1}, "x", ["u"], True),
        ({"reply": None, "response": "y"}, "y", [], False),
        ({"reply": ""}, C.EMPTY_REPLY, [], False),
        ({"reply": 5, "end_of_conversation": "false"}, "5", [], True),
        ({"reply": True, "end_of_conversation": ""}, "True", [], False),
        ({"reply": "r", "recommendations": [1, None, {"name": "", "url": "u"}, {"name": "n"}, {"name": "n", "url": "v"}]}, "r", ["v"], False),
        ({"reply": "r", "recommendations": [{"name": "n", "url": str(i)} for i in range(12)]}, "r", [str(i) for i in range(10)], False),
        ({"reply": "r", "recommendations": "text", "end_of_conversation": []}, "r", [], False),
    ],
)
def test_normalisation(spark, body, reply, urls, end):
    row = clean(spark, {1: json.dumps(body)})[1]
    assert (row.reply, [r.url for r in row.recommendations], row.end_of_conversation) == (reply, urls, end)


def test_types_in_a_list(spark):
    item = {"name": "n", "url": "u", "test_types": ["K", "P"]}
    row = clean(spark, {1: json.dumps({"reply": "r", "recommendations": [item]})})[1]
    assert row.recommendations[0].test_type == "['K', 'P']"


@pytest.mark.parametrize(
    "types, text",
    [([1, 2], "[1, 2]"), (["a", None, True], "['a', None, True]"), (["it's"], "[\"it's\"]"), ([], "[]")],
)
def test_lists_as_text(spark, types, text):
    item = {"name": "n", "url": "u", "test_type": types}
    row = clean(spark, {1: json.dumps({"reply": "r", "recommendations": [item]})})[1]
    assert row.recommendations[0].test_type == text


@pytest.mark.parametrize("given", [5, 0, 1.5, True])
def test_recommendations_that_are_no_list(spark, given):
    row = clean(spark, {1: json.dumps({"reply": "r", "recommendations": given, "end_of_conversation": True})})[1]
    assert row.reply == C.APOLOGY_REPLY and not row.recommendations and not row.end_of_conversation


def test_half_of_a_pair(spark):
    got = clean(spark, {1: '{"reply": "a\\ud800b"}', 2: TEXT})
    assert got[1].reply == "a?b" and got[2].reply == "Hi"


def test_schema_errors(spark):
    bodies = {
        1: FULL,
        2: {},
        3: {"reply": " ", "recommendations": None, "end_of_conversation": "no"},
        4: {"reply": 1, "recommendations": [1, {"name": "n"}], "end_of_conversation": False},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()], "conv_id long, response string")
    got = {r.conv_id: r.errors for r in ev.schema_errors(rows).collect()}
    assert got == {
        1: [],
        2: ["reply: missing", "recommendations: missing", "end_of_conversation: missing"],
        3: ["reply: empty", "recommendations: not a list", "end_of_conversation: not a boolean"],
        4: ["reply: not a string", "recommendations[0]: not an object", "recommendations[1]: no url", "recommendations[1]: no test_type"],
    }


def test_recall(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    predicted = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 11, "c"), (2, 1, "z")], "query_id long, rank int, url string")
    truth = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "y")], "query_id long, url string")
    recalls = ev.recall_at_k(queries, predicted, truth)
    assert {r.query_id: r.recall for r in recalls.collect()} == {1: 0.5, 2: 0.0, 3: 1.0}
    assert ev.mean_recall(recalls).first()[0] == pytest.approx(0.5)
    assert ev.mean_recall(recalls.where("false")).first()[0] == 0.0
    assert {r.url for r in ev.misses(predicted, truth).where("query_id = 1").collect()} == {"c", "d"}
    assert {r.url for r in ev.hits(predicted, truth).collect()} == {"a", "b"}


def test_emit(spark, tmp_path):
    rows = spark.createDataFrame([(1, TEXT)], "conv_id long, raw string")
    cleaned = rsp.clean_responses(rows)
    assert json.loads(rsp.to_responses(cleaned).first().response) == FULL
    rsp.write_responses(cleaned, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().reply == "Hi"


def test_ingest(spark):
    from shortlist.operators.vector_search import hashing_encoder

    lines = ['{"id": 1, "name": "n", "description": "java test", "test_types": ["K"]}', "broken", '{"name": "no id"}']
    raw = spark.createDataFrame([(x,) for x in lines], "value string")
    row = cat.ingest_catalog(raw, hashing_encoder(8)).collect()
    assert len(row) == 1 and row[0].job_levels == [] and row[0].duration == "" and len(row[0].embedding) == 8
    assert tuple(cat.to_recommendation(cat.ingest_catalog(raw)).first()) == ("n", None, "K")
