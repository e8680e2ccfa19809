"""Lookups of names from stored grams."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from shortlist.operators import lookup, names
from shortlist.schemas import CATALOG
from shortlist.session import shared_folder
from tests.test_search import plan_of


def catalog_of(spark, texts):
    rows = [(i, n, f"u/{i}", [], "", "", [], True, True, None) for i, n in enumerate(texts)]
    return spark.createDataFrame(rows, CATALOG)


def asked_for(spark, needles):
    return spark.createDataFrame([(n,) for n in needles], "name string")


def found(rows):
    return {r.needle: r.id for r in rows.collect()}


@pytest.mark.parametrize("sent", [names.SENT_ROWS, 0])
def test_stored_names_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(names, "SENT_ROWS", sent)
    rng = random.Random(4)
    texts = ["".join(rng.choices("abC é%", k=rng.randint(0, 14))) for _ in range(150)] + ["Dup", "dUP", "a" * 3000]
    needles = ["".join(rng.choices("abcd é%_", k=rng.randint(0, 9))) for _ in range(120)]
    needles += [t[1:10] for t in texts[:40]] + ["dup", "DUP", None, "a" * 2999, "a" * 3001]
    stored = names.store_names(catalog_of(spark, texts), buckets=8)
    got = found(names.resolve_stored(asked_for(spark, needles), stored))
    want = {}
    for n in {n.lower() for n in needles if n and n.strip()}:
        equal = [i for i, t in enumerate(texts) if t.lower() == n]
        inside = [i for i, t in enumerate(texts) if n in t.lower()]
        if inside:
            want[n] = min(equal or inside)
    assert got == want and len(want) > 40


def test_same_as_the_lookup_without_a_store(spark, catalog):
    stored = names.store_names(catalog, buckets=4)
    wanted = ["CORE JAVA", "java adv", "Java", "v", "50%", "%", "5_% plus", "verbal 50% pl", "", "  ", "ical", "xyz", None]
    asked = asked_for(spark, wanted)
    plain = lookup.lookup_by_name(asked, catalog)
    assert sorted(map(str, lookup.lookup_by_name(asked, catalog, stored).collect())) == sorted(map(str, plain.collect()))


def test_only_partitions_of_the_grams_are_read(spark):
    texts = [f"name {i} of {'many' if i % 3 else 'some'}" for i in range(400)]
    stored = names.store_names(catalog_of(spark, texts))
    needles = spark.createDataFrame([("e 77 of so",), ("e 399",), ("me 12x of",)], "needle string")
    rarest = names.rarest_grams(needles, stored)
    assert {r.needle for r in rarest.select("needle").distinct().collect()} == {"e 399", "e 77 of so"}
    assert rarest.where("gram in ('nam', 'ame', ' of')").count() == 0
    heads = plan_of(stored.heads.join(names._sent(rarest.select("needle", "gram", "bucket"), F.length("gram") > 0), ["bucket", "gram"]))
    assert "dynamicpruning" in heads
    plan = plan_of(names.containing_names(needles, stored))
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    # The names are met as they are stored: what is cut into grams lies outside this plan.
    assert "Generate explode(array_distinct" not in plan
    assert found(names.containing_names(needles, stored)) == {"e 399": 399}


def test_a_gram_of_all_names_meets_only_what_holds_the_rare_ones(spark):
    texts = [f"common {chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(500)]
    stored = names.store_names(catalog_of(spark, texts), buckets=8)
    needles = spark.createDataFrame([("common cd",), ("mmon b",)], "needle string")
    chosen = names.rarest_grams(needles, stored)
    met = chosen.where("needle = 'common cd'").join(stored.heads, ["bucket", "gram"])
    assert met.agg(F.min("n")).first()[0] == 1
    assert found(names.containing_names(needles, stored)) == {"common cd": 80, "mmon b": 1}


def test_empty_catalog_empty_needles_and_null_names(spark):
    stored = names.store_names(catalog_of(spark, []), buckets=4)
    assert found(names.resolve_stored(asked_for(spark, ["a", "abcdef", ""]), stored)) == {}
    some = names.store_names(catalog_of(spark, [None, "", " ", "ab"]), buckets=4)
    assert found(names.resolve_stored(asked_for(spark, []), some)) == {}
    assert found(names.resolve_stored(asked_for(spark, ["a", " ", None, "abc"]), some)) == {"a": 3}


def test_dropped_names_leave_no_files(spark, catalog):
    names.store_names(catalog, "dropped_names", buckets=2)
    again = names.open_names(spark, "dropped_names", 2)
    assert found(names.resolve_stored(asked_for(spark, ["core java"]), again)) == {"core java": 1}
    names.drop_names(spark, "dropped_names")
    assert not os.path.exists(f"{shared_folder(spark)}/dropped_names")
    assert not spark.catalog.tableExists("dropped_names_grams")
