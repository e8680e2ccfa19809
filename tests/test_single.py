"""Sums in single precision leave exact results and few exact sums."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from shortlist.operators import blocks, hybrid, single
from shortlist.operators.index import build_index
from shortlist.schemas import CATALOG
from tests.test_search import NOTHING, QUERY, dense, random_case, rows_of

ITEM = {"id": pa.int64(), "allowed": pa.list_(pa.int64()), "words": pa.list_(pa.string()), "tfs": pa.list_(pa.int64()), "length": pa.int64(), "avg_length": pa.float64(), "embedding": pa.list_(pa.float32())}
ASKED = {"query_id": pa.int64(), "filter_no": pa.int64(), "words": pa.list_(pa.string()), "idfs": pa.list_(pa.float64()), "n_terms": pa.float64(), "vector": pa.list_(pa.float32()), "low": pa.float64(), "span": pa.float64(), "bound": pa.float64()}


def case(n_items, n_queries, bound=None, seed=4):
    """Items of two kinds of words, some without a vector, some permitted by a filter set; some items come twice."""
    rng = random.Random(seed)
    kinds = [[f"{kind}{n}" for n in range(60)] for kind in "ab"]
    items = []
    for i in range(n_items):
        own = sorted({rng.choice(kinds[i % 2][: rng.randint(1, 60)]) for _ in range(rng.randint(0, 30))})
        row = {"allowed": [n for n in (0, 1) if rng.random() < 0.4], "words": own, "tfs": [rng.randint(1, 4) for _ in own], "length": 2 * len(own), "avg_length": 20.0}
        row["embedding"] = rng.choice([None, [rng.uniform(-1, 1) for _ in range(4)]])
        items.append({"id": i, **(items[-7] if i % 50 == 49 else row)} | {"id": i})
    asked = []
    for q in range(n_queries):
        some = rng.sample([*kinds[q % 2], "none"], rng.randint(0, 25))
        row = {"query_id": q, "filter_no": rng.choice([None, 0, 1]), "words": some, "idfs": [rng.uniform(0.1, 9) for _ in some], "n_terms": float(len(some))}
        asked.append(row | {"vector": rng.choice([None, [rng.uniform(-1, 1) for _ in range(4)]]), "low": 0.0, "span": 120.0, "bound": bound})
    tables = (pa.Table.from_pylist(rows, schema=pa.schema(list(kinds.items()))) for rows, kinds in ((items, ITEM), (asked, ASKED)))
    return tables


def plain_sums(items, queries):
    """Raw sums of all pairs in double precision, NaN where a filter set does not permit the item."""
    block, of = blocks.ItemBlock(items), blocks.QueryBlock.of(queries)
    every = np.arange(items.num_rows)
    raw = blocks.WordScores(block, of).of(np.arange(queries.num_rows), every)[0]
    for number, members in of.by_filter:
        out = np.setdiff1d(every, block.permitted(number))
        raw[np.ix_(members, out)] = np.nan
    return block, of, raw


@pytest.mark.parametrize("few", [1, 10**9])
@pytest.mark.parametrize("n_items", [90, 1500])
def test_ranges_are_those_of_all_sums(monkeypatch, few, n_items):
    monkeypatch.setattr(single, "_FEW_QUERIES", few)
    monkeypatch.setattr(single, "_AT_ONCE", 7 * n_items)
    block, queries, raw = plain_sums(*case(n_items, 60))
    got = pd.concat(blocks.word_ranges(block, queries)).set_index("query_id")
    for q, sums in enumerate(raw):
        sums = sums[~np.isnan(sums)]
        assert got.high[q] == sums.max() and got.missed[q] == float(sums.min() <= 0)
        assert got.missed[q] or got.least[q] == sums.min()


@pytest.mark.parametrize("bound", [None, 0.3, 0.5])
@pytest.mark.parametrize("few", [1, 10**9])
def test_best_are_those_of_all_scores(monkeypatch, few, bound):
    monkeypatch.setattr(single, "_FEW_QUERIES", few)
    monkeypatch.setattr(single, "_AT_ONCE", 9_000)
    block, queries, raw = plain_sums(*case(1500, 60, bound))
    summed, real = [], blocks.WordScores.pairs
    monkeypatch.setattr(blocks.WordScores, "pairs", lambda *a: [summed.append(len(a[2])), real(*a)][1])
    got = pd.concat(blocks.fused_block(block, queries, blocks.Scoring(5, 0.4, vectors_only=False)))
    matrix, _ = block.vectors(4)
    score = 0.4 * raw / 120 + 0.6 * (queries.vectors @ matrix.T)
    for q in range(60):
        want = sorted((-round(s, 9), i) for s, i in zip(score[q], block.ids, strict=True) if not np.isnan(s) and (bound is None or s >= bound))[:5]
        mine = got[got.query_id == q].sort_values("score", ascending=False)
        assert sorted((-round(s, 9), i) for s, i in zip(mine.score, mine.id, strict=True)) == want
    # Few of the 90,000 pairs are summed exactly; queries without words and vector tie with all items.
    assert 0 < sum(summed) < 9_000


def test_items_with_like_words_lie_side_by_side():
    items, _ = case(3000, 1)
    block = blocks.ItemBlock(items)
    assert len(block.cuts) == 9 and block.cuts[-1] == 3000 and sorted(block.ids) == list(range(3000))
    words = dict(zip(items["id"].to_pylist(), items["words"].to_pylist(), strict=True))
    mixed = 0
    for start, end in zip(block.cuts, block.cuts[1:], strict=False):
        kinds = [words[i][0][0] for i in block.ids[start:end] if words[i]]
        mixed += min(kinds.count("a"), kinds.count("b"))
    assert mixed < 300


@pytest.mark.parametrize("one", [False, True])
def test_few_items_are_read_by_groups_of_tasks(spark, monkeypatch, one):
    items, asked = random_case(n_items=400, n_queries=30, seed=41)
    index = build_index(spark.createDataFrame(items, CATALOG))
    if one:
        # All groups may lie in one partition.
        index = hybrid.CatalogIndex(index.catalog, index.items.coalesce(1), index.term_stats, index.corpus)
    monkeypatch.setattr(blocks, "MAX_SENT_QUERIES", 16)
    monkeypatch.setattr(hybrid, "FIRST_SAMPLE", 50)
    monkeypatch.setattr(hybrid, "GROWTH", 4)
    seen, whole = [], hybrid.each_block

    def counted(rows, *more):
        found = whole(rows, *more)
        seen.append((rows.rdd.getNumPartitions(), found.rdd.getNumPartitions()))
        return found

    monkeypatch.setattr(hybrid, "each_block", counted)
    got = rows_of(hybrid.search_hybrid(spark.createDataFrame(asked, QUERY), index, k=3, limits=NOTHING))
    assert any(few == 1 and tasks > 1 for few, tasks in seen), seen
    for q in asked:
        assert got.get(q[0], []) == [tuple(round(x, 6) for x in r) for r in dense(items, q, 0.4)[:3]]
