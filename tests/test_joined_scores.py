"""Few rows leave the items: best hits, details of found items, terms counted as arrays."""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import pytest

from shortlist.operators import hybrid, lexical
from shortlist.operators.index import build_index, counted
from shortlist.operators.queries import Limits, query_table
from shortlist.schemas import CATALOG
from tests.test_search import NOTHING, QUERY, random_case
from workload import queries as registered
from workload import views


def _rows(df, *names):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect()), key=str)


@pytest.mark.parametrize("limits", [Limits(), NOTHING])
@pytest.mark.parametrize("repeat", [False, True])
def test_best_hits_are_the_best_of_all_hits(spark, limits, repeat):
    items, asked = random_case(n_items=300, n_queries=25, seed=21)
    index = build_index(spark.createDataFrame(items + items[:3] * repeat, CATALOG))
    assert index.unique != repeat
    table = query_table(spark.createDataFrame(asked, QUERY), limits)
    hits = lexical.lexical_hits(table, index)
    want = lexical.ranked(hybrid.minmax(hits, table, index), "value", 5)
    got, scales = hybrid.best_hits(table, index, 5)
    columns = "query_id", "id", "value", "rank"
    assert _rows(got, *columns) == _rows(want, *columns) != []
    # The scales of all items hold for the hits of some.
    some = got.select("id").where("id % 2 = 0").distinct()
    few = hybrid.minmax(lexical.lexical_hits(table, index.only(some)), table, index, scales)
    all_hits = hybrid.minmax(hits, table, index).join(some, "id", "left_semi")
    assert _rows(few, "query_id", "id", "value") == _rows(all_hits, "query_id", "id", "value") != []


def test_joined_scores_find_all_hits_of_no_more_items_than_needed(spark, monkeypatch):
    items, asked = random_case(n_items=400, n_queries=4, seed=22)
    index = build_index(spark.createDataFrame(items, CATALOG))
    queries = spark.createDataFrame(asked, QUERY)
    met, plain = [], lexical.lexical_hits

    def seen(table, index, require_all=False):
        met.append(index.items.count())
        return plain(table, index, require_all)

    monkeypatch.setattr(lexical, "lexical_hits", seen)
    monkeypatch.setattr(views, "index", lambda *_: index)
    monkeypatch.setattr(views, "items", lambda *_: index.items)
    monkeypatch.setattr(views, "search_queries", lambda *_, **__: queries)
    assert registered._joined_scores(spark, "").count() > 0
    assert met and max(met) <= 2 * 10 * len(asked) < len(items)


@pytest.mark.parametrize("few", [True, False])
def test_texts_of_other_items_are_not_joined(spark, few):
    """A catalog that is a join meets the ids before its texts are shuffled."""
    ids = [(n, f"text {n}") for n in range(50)] + [(None, "no id"), (7, "again")]
    texts = spark.createDataFrame(ids, "id long, description string")
    rest = spark.range(60).selectExpr(
        "id", "'n' as name", "'u' as url", "array('K') as test_types", "'' as duration",
        "array('M') as job_levels", "true as remote_testing", "false as adaptive",
    )
    catalog = texts.hint("merge").join(rest, "id")
    hits = spark.createDataFrame([(1, 1, 7), (1, 2, 3), (2, 1, 7), (3, 1, None), (4, 1, 99)], "query_id long, rank int, id long")
    found = hybrid.with_details(hits, catalog, few=few)
    got = sorted((r.query_id, r["rank"], r.id, r.description) for r in found.collect())
    assert got == [(1, 1, 7, "again"), (1, 1, 7, "text 7"), (1, 2, 3, "text 3"), (2, 1, 7, "again"), (2, 1, 7, "text 7")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The ids are met above the scan of the texts, below the join with the rest.
    assert re.search(r"BroadcastHashJoin \[id#\d+L\][^\n]*LeftSemi[^\n]*\n[^\n]*Filter[^\n]*\n[^\n]*Scan ExistingRDD\[id#\d+L,description", plan), plan


def test_terms_are_counted_as_arrays():
    lists = [["b", "a", "b"], None, [], ["é", "z", "é", "𝄞", "z"], ["a"]]
    given = pa.array([["x"], *lists], pa.list_(pa.string())).slice(1)
    got = counted(given).to_pylist()
    assert [x if x is None else {t["term"]: t["tf"] for t in x} for x in got] == [x if x is None else Counter(x) for x in lists]
    assert all([t["term"] for t in x] == sorted({t["term"] for t in x}, key=str.encode) for x in got if x)
    assert counted(given.slice(0, 0)).to_pylist() == [] and counted(given.slice(1, 2)).to_pylist() == [None, []]
