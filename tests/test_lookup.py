"""Lookups and repair."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shortlist.operators import lookup
from shortlist.schemas import CATALOG, RESPONSE


def test_lookup_by_url(spark, catalog):
    keys = spark.createDataFrame([("u/1",), ("u/1",), ("nope",), ("",)], "url string")
    got = {r.url: r.id for r in lookup.lookup_by_url(keys, catalog).collect()}
    assert got == {"u/1": 1, "nope": None, "": None}


def test_lookup_by_name(spark, catalog):
    wanted = {
        "CORE JAVA": 1,
        "core java": 1,
        "java adv": 2,
        "Java": 1,
        "v": 1,
        "50%": 4,
        "%": 4,
        "5_% plus": None,
        "verbal 50% pl": 4,
        "verbal 51% pl": None,
        "": None,
        "  ": None,
        "ical": 5,
        "xyz": None,
    }
    names = spark.createDataFrame([(n,) for n in wanted], "name string")
    got = {r.needle: r.id for r in lookup.lookup_by_name(names, catalog).collect()}
    assert got == {k.lower(): v for k, v in wanted.items()}
    exact = {r.needle: r.id for r in lookup.exact_names(names, catalog).collect()}
    assert exact == {"core java": 1}


def test_names_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc ", k=rng.randint(1, 14))) for _ in range(150)]
    items = [(i, n, f"u/{i}", [], "", "", [], True, True, None) for i, n in enumerate(texts)]
    needles = sorted({"".join(rng.choices("abcd ", k=rng.randint(1, 10))).strip() for _ in range(120)} - {""})
    needles += [t[1:10] for t in texts[:20] if t[1:10].strip()]
    names = spark.createDataFrame([(n,) for n in needles], "name string")
    got = {r.needle: r.id for r in lookup.resolve_names(names, spark.createDataFrame(items, CATALOG)).collect()}
    for n in needles:
        equal = [i for i, t in enumerate(texts) if t == n]
        inside = [i for i, t in enumerate(texts) if n in t]
        assert got.get(n) == (min(equal) if equal else min(inside, default=None)), n


def test_url_checks_keep_repeats(spark, catalog):
    rows = spark.createDataFrame([(1, "u/1"), (2, "bad"), (3, "bad"), (3, "bad"), (4, ""), (5, None), (6, "u/1")], "ref int, url string")
    assert sorted(tuple(r) for r in lookup.invalid_urls(rows, catalog).select("ref", "url").collect()) == [(2, "bad"), (3, "bad"), (3, "bad")]
    assert sorted(r.ref for r in lookup.valid_recommendations(rows, catalog).collect()) == [1, 6]


def test_repair(spark, catalog):
    many = [(f"n{i}", "u/1", "Z") for i in range(14)]
    responses = spark.createDataFrame(
        [
            (1, "r", [("My name", "u/2", "X"), ("CORE JAVA", "bad", "X"), ("unknown thing", "bad", "X"), ("", "bad", ""), ("50%", "", "")], False),
            (2, "r", [], False),
            (3, "r", many, False),
            (4, "r", [("nothing", "bad", "")], False),
        ],
        "conv_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESPONSE),
    )
    rows = lookup.repair_recommendations(responses, catalog).collect()
    got = {r.conv_id: [tuple(x) for x in r.recommendations] for r in rows}
    assert got[1] == [("My name", "u/2", "X"), ("Core Java", "u/1", "K"), ("Verbal 50% Plus", "u/4", "")]
    assert got[2] == [] and got[4] == []
    assert got[3] == many[:10]


def test_hot_keys_are_spread(spark):
    from shortlist.operators.joins import spread_join

    rows = spark.range(4000).select("id", F.lit("hot").alias("k"))
    one = spark.createDataFrame([("hot", 1)], "k string, v int")
    assert spread_join(rows, one, "k").where("v = 1").count() == 4000
    assert spread_join(rows, one, "k", "left_anti").count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_keys_are_not_broadcast_by_estimate(spark):
    """The estimate of a table does not count the repeats; a measured one is final."""
    from shortlist.operators.joins import spread_join
    from shortlist.session import sent_if_few

    rows, one = spark.range(4000).selectExpr("id", "id % 7 AS k"), spark.range(5).selectExpr("id AS k", "id AS v")
    for how in ("left", "left_semi", "left_anti", "inner"):
        assert "Broadcast" not in plan_of(spread_join(rows, one, "k", how)), how
    assert spread_join(rows, one, "k", "left_semi").count() == 4000 - 2 * 571
    assert "Broadcast" not in plan_of(rows.join(sent_if_few(one, 4), "k"))
    assert "BroadcastHashJoin" in plan_of(rows.join(sent_if_few(one, 5), "k"))
