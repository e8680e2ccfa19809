"""Searches against brute force on small tables."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shortlist.functions.filters import minutes, permits
from shortlist.functions.vectors import cosine, l2_normalize
from shortlist.operators import blocks, filters, hybrid, lexical
from shortlist.operators import vector_search as vec
from shortlist.operators.index import META, build_index, drop_index, filter_rows
from shortlist.operators.queries import Limits, query_table
from shortlist.schemas import CATALOG, FILTERS
from tests.conftest import ITEMS
from tests.test_text import plain_terms

NOTHING = Limits(queries=0, bytes=0)
QUERY = "query_id long, text string, vector array<float>, filters " + FILTERS.simpleString()


def allowed(item, f):
    _, _, _, types, _, duration, levels, remote, adaptive, _ = item
    if f is None:
        return True
    digits = "".join(c for c in (duration or "") if c.isdigit())
    tests = [
        f[0] is None or bool(set(f[0]) & set(types or [])),
        f[1] is None or bool(set(f[1]) & set(levels or [])),
        f[2] is None or remote == f[2],
        f[3] is None or adaptive == f[3],
        f[4] is None or (digits != "" and int(digits) <= f[4]),
    ]
    return all(tests)


def unit(v):
    n = math.sqrt(sum(x * x for x in v)) if v else 0
    return None if not n else [x / n for x in v]


def dense(items, query, alpha):
    """All eligible items of one query with their fused score, best first."""
    _, text, vector, f = query
    docs = {i[0]: plain_terms(" ".join(x for x in (i[1], i[4]) if x)) for i in items}
    mean = sum(len(d) for d in docs.values()) / len(docs)
    eligible = [i for i in items if allowed(i, f)]

    def bm25(doc):
        total = 0.0
        for t in set(plain_terms(text or "")):
            df, tf = sum(t in d for d in docs.values()), doc.count(t)
            if tf:
                idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return total

    raw = {i[0]: bm25(docs[i[0]]) for i in eligible}
    high, low = max(raw.values(), default=0), min(raw.values(), default=0)
    out = []
    for i in eligible:
        x = raw[i[0]]
        scaled = 0.0 if high == 0 else (float(x > 0) if high == low else (x - low) / (high - low))
        a, b = unit(i[9]), unit(vector)
        c = float(np.dot(a, b)) if a and b else 0.0
        out.append((i[0], alpha * scaled + (1 - alpha) * c, scaled, c))
    return sorted(out, key=lambda r: (-round(r[1], 9), r[0]))


QUERIES = [
    (1, "java developers", [1.0, 0.1, 0.0], None),
    (2, "no such words", [0.0, 1.0, 0.0], (["K"], None, None, None, None)),
    (3, "", None, None),
    (4, "java", [0.0, 0.0, 0.0], (["K"], None, None, None, None)),
    (5, "verbal java numerical sales", [0.3, 0.3, 0.3], (None, ["Manager", "Director"], None, None, None)),
    (6, "sales", [1.0, 1.0, 1.0], (None, None, True, False, None)),
    (7, "test", None, (None, None, None, None, 45)),
    (8, "java", [1.0, 1.0, 1.0], ([], None, None, None, None)),
]


def rows_of(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 6), round(r.bm25_score, 6), round(r.cosine_score, 6)))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


@pytest.mark.parametrize("alpha", [None, 0.0, 1.0])
@pytest.mark.parametrize("limits", [Limits(), NOTHING])
def test_hybrid_is_the_dense_result(spark, index, alpha, limits):
    queries = spark.createDataFrame(QUERIES, QUERY)
    got = rows_of(hybrid.search_hybrid(queries, index, k=3, alpha=alpha, limits=limits))
    for q in QUERIES:
        want = [tuple(round(x, 6) for x in r) for r in dense(ITEMS, q, 0.4 if alpha is None else alpha)[:3]]
        assert got.get(q[0], []) == want, q


def random_case(n_items=60, n_queries=17, seed=3):
    rng = random.Random(seed)
    words = ["java", "sales", "verbal", "test", "coding", "people", "drive"]

    def vector():
        return rng.choice([None, [float(rng.randint(-2, 2)) for _ in range(4)]])

    items = [
        (
            i,
            rng.choice(words),
            f"u/{i}",
            rng.choice([None, [], ["K"], ["A", "K"], ["P"]]),
            " ".join(rng.choices(words, k=rng.randint(0, 6))),
            rng.choice([None, "", "Variable", "20 minutes", "40 minutes"]),
            rng.choice([None, ["Manager"], ["Director", "Executive"]]),
            rng.choice([True, False]),
            rng.choice([True, False]),
            vector(),
        )
        for i in range(n_items)
    ]
    queries = [
        (
            q,
            " ".join(rng.choices(words + ["none"], k=rng.randint(0, 3))),
            vector(),
            rng.choice([None, (["K"], None, None, None, None), (None, ["Manager"], True, None, 30), (None, None, None, False, None)]),
        )
        for q in range(n_queries)
    ]
    return items, queries


def test_small_cells_change_nothing(spark, monkeypatch):
    items, asked = random_case()
    monkeypatch.setattr(blocks, "ITEMS_PER_CELL", 7)
    monkeypatch.setattr(blocks, "QUERIES_PER_CELL", 5)
    monkeypatch.setattr(blocks, "_SCORES_AT_ONCE", 50)
    index = build_index(spark.createDataFrame(items, CATALOG))
    queries = spark.createDataFrame(asked, QUERY)
    sent = rows_of(hybrid.search_hybrid(queries, index, k=5))
    grid = rows_of(hybrid.search_hybrid(queries, index, k=5, limits=NOTHING))
    assert sent == grid
    for q in asked:
        want = [tuple(round(x, 6) for x in r) for r in dense(items, q, 0.4)[:5]]
        assert sent.get(q[0], []) == want


def test_both_filter_rules_agree(spark):
    items, asked = random_case(seed=5)
    rows = filter_rows(spark.createDataFrame(items, CATALOG))
    queries = spark.createDataFrame(asked, QUERY)
    want = {q[0]: sum(allowed(i, q[3]) for i in items) for q in asked}
    for limits in (Limits(), NOTHING):
        got = filters.eligible_counts(queries, rows, limits).collect()
        assert {r.query_id: r.n_eligible for r in got} == want
    filtered = queries.where("filters is not null").select("query_id", "filters")
    passes = permits(F.col("filters"), {n: F.col(n) for n in META})
    pairs = rows.join(filtered, passes).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in pairs} == {q[0]: want[q[0]] for q in asked if q[3] and want[q[0]]}


def test_search_lexical_needs_all_terms(spark, index):
    queries = spark.createDataFrame([(1, "java developers"), (2, "java"), (3, "java unknown"), (4, "the")], "query_id long, text string")
    for limits in (Limits(), NOTHING):
        got = lexical.search_lexical(queries, index, limits=limits).collect()
        by = {q: {r.id for r in got if r.query_id == q} for q in (1, 2, 3, 4)}
        assert by == {1: {1}, 2: {1, 2, 6}, 3: set(), 4: set()}
    loose = lexical.search_lexical(queries, index, require_all=False).where("query_id = 3").collect()
    assert {r.id for r in loose} == {1, 2, 6}


def test_search_vector(spark, index):
    queries = spark.createDataFrame(QUERIES, QUERY)
    got = {}
    for r in vec.search_vector(queries, index.items, k=4).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.cosine_score, 6)))
    for q in QUERIES:
        usable = [i for i in ITEMS if allowed(i, q[3]) and unit(i[9]) and unit(q[2])]
        want = sorted(((i[0], round(float(np.dot(unit(i[9]), unit(q[2]))), 6)) for i in usable), key=lambda r: (-r[1], r[0]))
        assert got.get(q[0], []) == want[:4]


def test_cells(spark, monkeypatch):
    monkeypatch.setattr(vec, "ITEMS_PER_CELL", 6)
    monkeypatch.setattr(vec, "QUERIES_PER_CELL", 4)
    items, asked = random_case(seed=9)
    rows = filter_rows(spark.createDataFrame(items, CATALOG))
    queries = spark.createDataFrame(asked, QUERY)

    def result(df):
        return sorted((r.query_id, r["rank"], r.id) for r in df.collect())

    exact = result(vec.search_vector(queries, rows, k=5))
    cells, centroids = vec.build_cells(rows, 4)
    assert result(vec.search_cells(queries, cells, centroids, n_probe=4, k=5)) == exact
    hot = rows.withColumn("cell", F.lit(0))
    assert result(vec.search_cells(queries, hot, vec.cell_centroids(hot), n_probe=1, k=5)) == exact
    few = result(vec.search_cells(queries, cells, centroids, n_probe=1, k=5))
    cell_of = {r.id: r.cell for r in cells.select("id", "cell").collect()}
    for q in {q for q, _, _ in few}:
        assert len({cell_of[i] for p, _, i in few if p == q}) == 1


def test_vector_columns(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    got = rows.select(l2_normalize(F.col("a")).alias("u"), cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert got[0].u == pytest.approx([0.6, 0.8]) and got[0].c == pytest.approx(0.96)
    assert got[1].u == [0.0, 0.0] and got[1].c is None
    assert got[2].u is None and got[2].c is None


def test_hashing_encoder(spark):
    rows = spark.createDataFrame([(1, "java test java"), (2, "test java java"), (3, "the"), (4, None)], "query_id long, text string")
    got = {r.query_id: r.vector for r in vec.hashing_encoder(32)(rows).collect()}
    assert got[1] == got[2] and len(got[1]) == 32
    assert math.isclose(sum(x * x for x in got[1]), 1.0, rel_tol=1e-5)
    assert not any(got[3]) and not any(got[4])


def test_minutes_and_filters(spark, catalog):
    got = {r.id: r.m for r in catalog.select("id", minutes(F.col("duration")).alias("m")).collect()}
    assert got == {1: 30, 2: 45, 3: None, 4: None, 5: None, 6: 3045}

    def ids(f):
        return sorted(r.id for r in filters.apply_filters(catalog, f).collect())

    assert ids(None) == [1, 2, 3, 4, 5, 6]
    assert ids({"test_type": "K"}) == [1, 2, 6]
    assert ids({"job_level": ["Manager"]}) == [1, 4]
    assert ids({"duration_max": 45}) == [1, 2]
    assert ids({"remote_testing": False, "adaptive": True}) == [2]


def test_filters_reach_the_scan(spark, catalog, tmp_path):
    from shortlist.sources.catalog import read_catalog, write_catalog

    write_catalog(catalog, str(tmp_path / "c"))
    stored = read_catalog(spark, str(tmp_path / "c"))
    plan = filters.filter_remote(stored, True).select("id")._jdf.queryExecution().toString()
    assert "EqualTo(remote_testing,true)" in plan
    assert "ReadSchema: struct<id:bigint,remote_testing:boolean>" in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_moves_only_its_best_rows(spark, index):
    queries = spark.createDataFrame(QUERIES, QUERY)
    for limits in (Limits(), NOTHING):
        plan = plan_of(vec.search_vector(queries, index.items, limits=limits))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        before = plan[: plan.index("MapInArrow")]
        assert before.count("Exchange hashpartitioning(query_id") == 1 and "WindowGroupLimit" in before
        # Nothing is exchanged by id, and the items are scanned once.
        assert "Exchange hashpartitioning(id" not in plan
        assert plan.count("MapInArrow") == 1 and plan.count("FileScan") == 1
    plan = plan_of(hybrid.search_hybrid(queries, index))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_large_query_tables_stay_off_the_driver(spark, index, monkeypatch):
    """No query row comes to the driver, and items are scanned once for all parts."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows = [(q, "java sales", [1.0, float(q % 7), 0.0], (["K"], None, None, None, None) if q % 2 else None) for q in range(10_000)]
    queries = spark.createDataFrame(rows, QUERY)
    few = {q: [r for r in vec.search_vector(queries.where(F.col("query_id") == q), index.items).collect()] for q in (0, 1, 9_999)}
    collected = []
    for name in ("collect", "toArrow", "toPandas"):
        whole = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, whole=whole: collected.append(whole(self)) or collected[-1])
    found = vec.search_vector(queries, index.items)
    assert plan_of(found).count("FileScan") == 1
    assert sum(len(c) for c in collected) < 100
    monkeypatch.undo()
    got = found.where(F.col("query_id").isin(*few)).collect()
    for q, want in few.items():
        assert sorted(r for r in got if r.query_id == q) == sorted(want)
    assert found.select("query_id").distinct().count() == 10_000


def test_only_hits_that_reach_the_bound_are_scored(spark, monkeypatch):
    """Rows that get a cosine: the k best by keywords and those that could beat the bound."""
    items, _ = random_case(n_items=3000, seed=11)
    rng = random.Random(4)
    items = [(*i[:9], [rng.gauss(0, 1) for _ in range(16)]) for i in items]
    index = build_index(spark.createDataFrame(items, CATALOG))
    texts = ["java sales", "people coding verbal", "drive test"]
    asked = [(q, text, [rng.gauss(0, 1) for _ in range(16)], None) for q, text in enumerate(texts)]
    queries = spark.createDataFrame(asked, QUERY)
    scored = []
    whole = hybrid._with_cosines
    monkeypatch.setattr(hybrid, "_with_cosines", lambda pairs, *more: scored.append(pairs.count()) or whole(pairs, *more))
    got = rows_of(hybrid.search_hybrid(queries, index, k=3))
    hits = lexical.lexical_hits(query_table(queries), index).count()
    assert 0 < sum(scored) < hits / 2, (scored, hits)
    for q in asked:
        assert got[q[0]] == [tuple(round(x, 6) for x in r) for r in dense(items, q, 0.4)[:3]]


def test_measure(spark):
    queries = spark.createDataFrame(QUERIES, QUERY)
    assert query_table(queries).small and query_table(queries).n_filtered == 6
    assert not query_table(queries, Limits(queries=7)).small
    assert not query_table(queries, Limits(bytes=100)).small


def test_odd_vectors_count_as_missing():
    import numpy as np
    import pyarrow as pa

    from shortlist.operators.blocks import unit_rows

    rows = [[1.0, 2.0, 2.0], [4.0], [], None, [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 1.0], [0.0, 3.0, 4.0]]
    matrix, present = unit_rows(pa.array(rows, pa.list_(pa.float64())))
    assert present.tolist() == [True] + [False] * 6 + [True]
    assert np.allclose(matrix[0], [1 / 3, 2 / 3, 2 / 3]) and np.allclose(matrix[-1], [0, 0.6, 0.8])
    assert not matrix[1:-1].any()
    assert unit_rows(pa.array([[], None], pa.list_(pa.float64())))[0] is None


def test_ties_leave_k_rows_a_query():
    import numpy as np

    from shortlist.operators.blocks import _candidates

    score = np.zeros((50, 4000))
    score[:, 7] = 1.0
    by_id = np.arange(4000)[::-1]
    q, i = _candidates(score, by_id, 3)
    assert len(q) == 150 and i[:3].tolist() == [7, 3999, 3998]


def test_dropped_index_leaves_no_files(spark, catalog):
    where = build_index(catalog, "gone").items.inputFiles()[0]
    assert os.path.exists(where.removeprefix("file://"))
    drop_index(spark, "gone")
    assert not os.path.exists(where.removeprefix("file://"))
    assert not spark.catalog.tableExists("gone_items")


def test_many_queries_are_sent_in_parts(spark, index):
    rows = [(q, "java sales", [1.0, float(q), 0.0], None) for q in range(50)]
    queries = spark.createDataFrame(rows, QUERY)
    for search in (lambda limits: hybrid.search_hybrid(queries, index, limits=limits), lambda limits: vec.search_vector(queries, index.items, limits=limits)):
        few, many = (sorted(map(str, search(limits).collect())) for limits in (Limits(), Limits(queries=0, bytes=0)))
        assert few == many and len(few) > 50


def test_wide_tables_are_not_sent(spark):
    from shortlist.session import sent_if_few

    rows = spark.createDataFrame([("x" * 1000,), (None,)], "name string")
    other = spark.createDataFrame([("y",)], "name string")
    plan = lambda df: other.join(df, "name")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(sent_if_few(rows, 10))
    assert "broadcast" not in plan(sent_if_few(rows, 1)) and "broadcast" not in plan(sent_if_few(rows, 10, 500))


@pytest.mark.parametrize("limits", [Limits(), NOTHING])
def test_hybrid_search_stores_no_row_per_hit(spark, monkeypatch, limits):
    items, asked = random_case(n_items=2000, n_queries=5, seed=12)
    index = build_index(spark.createDataFrame(items, CATALOG))
    stored, whole = [], hybrid.materialize
    monkeypatch.setattr(hybrid, "materialize", lambda df: [d := whole(df), stored.append(d.count())][0])
    got = rows_of(hybrid.search_hybrid(spark.createDataFrame(asked, QUERY), index, k=3, limits=limits))
    assert stored and max(stored) <= 3 * len(asked)
    for q in asked:
        assert got.get(q[0], []) == [tuple(round(x, 6) for x in r) for r in dense(items, q, 0.4)[:3]]


@pytest.mark.parametrize("limits", [Limits(), NOTHING])
def test_hits_need_no_sums_over_rows(spark, limits):
    """Hits leave the items as they are found, and are those of the joins."""
    items, asked = random_case(n_items=300, n_queries=9, seed=13)
    index = build_index(spark.createDataFrame(items, CATALOG))
    assert index.unique
    for text_only in (False, True):
        queries = spark.createDataFrame(asked, QUERY)
        table = query_table(queries.drop("filters") if text_only else queries, limits)
        for require_all in (False, True):
            found = lexical.lexical_hits(table, index, require_all)
            assert not text_only or "Aggregate" not in plan_of(found)
            got, want = (
                sorted((r.query_id, r.id, round(r.raw, 9)) for r in rows.collect())
                for rows in (found, lexical._joined_hits(table, index, require_all))
            )
            assert got == want and got


def test_rows_of_repeated_ids_count_together(spark):
    items, _ = random_case(n_items=40, seed=14)
    index = build_index(spark.createDataFrame([*items, items[3]], CATALOG))
    assert not index.unique
    queries = spark.createDataFrame([(1, "java sales"), (None, "test"), (1, "verbal")], "query_id long, text string")
    assert not query_table(queries).unique
    hits = lexical.lexical_hits(query_table(queries), index)
    assert hits.count() == hits.select("query_id", "id").distinct().count() > 0


@pytest.mark.parametrize("limits", [Limits(), NOTHING])
def test_items_are_prepared_once_and_weighed_as_arrays(spark, monkeypatch, limits):
    """Items bring plain counts; a block prepares them once, however many parts of queries it meets."""
    items, asked = random_case(n_items=300, n_queries=12, seed=21)
    index = build_index(spark.createDataFrame(items, CATALOG))
    table = query_table(spark.createDataFrame(asked, QUERY), limits)
    marked, queries = lexical.with_words(*filters.numbered(index.items, table), index)
    plan = marked._jdf.queryExecution().optimizedPlan().toString()
    assert set(blocks.ITEM_WORDS) <= set(marked.columns) and "lambda" not in plan.lower()

    rows, found, made, real = queries.rows.toArrow(), [], [], blocks.unit_rows
    block = blocks.ItemBlock(marked.select(*blocks.ITEM_WORDS, "embedding").toArrow())
    monkeypatch.setattr(blocks, "unit_rows", lambda *given: [made.append(len(given[0])), real(*given)][1])
    for first in range(0, rows.num_rows, 5):
        part = blocks.QueryBlock.of(rows.slice(first, 5))
        found += [(r.query_id, r.id, round(r.raw, 9)) for f in blocks.word_hits(block, part) for r in f.itertuples()]
        block.vectors(3)
    assert made.count(300) == 1
    hits = lexical._joined_hits(table, index, False).collect()
    assert sorted(found) == sorted((r.query_id, r.id, round(r.raw, 9)) for r in hits) and found


def test_rows_that_leave_tasks_do_not_grow_with_blocks(spark, monkeypatch):
    """Many queries meet samples first: a block leaves only what changes a range or reaches the bound."""
    items, asked = random_case(n_items=2000, n_queries=12, seed=31)
    rng = random.Random(8)
    items = [(*i[:9], [float(rng.randint(-99, 99)) for _ in range(8)]) for i in items]
    asked = [(q, text, [float(rng.randint(-99, 99)) for _ in range(8)], f) for q, text, _, f in asked]
    index = build_index(spark.createDataFrame(items, CATALOG))
    monkeypatch.setattr(hybrid, "FIRST_SAMPLE", 100, raising=False)
    monkeypatch.setattr(hybrid, "GROWTH", 4, raising=False)
    parts, left, whole = 40, [], hybrid.each_block

    def spread(rows, table):
        marked, queries = filters.numbered(rows, table)
        return marked.repartition(parts, "id"), queries

    def counted(rows, *more):
        found = whole(rows, *more)
        left.append((found.rdd.getNumPartitions(), found.count()))
        return found

    monkeypatch.setattr(hybrid, "numbered", spread)
    monkeypatch.setattr(hybrid, "each_block", counted)
    got = rows_of(hybrid.search_hybrid(spark.createDataFrame(asked, QUERY), index, k=3, limits=NOTHING))
    over_all = [n for blocks_met, n in left if blocks_met == parts]
    assert len(over_all) == 2 and over_all[0] < 10 * len(asked) and over_all[1] < 3 * 15 * len(asked), left
    for q in asked:
        assert got.get(q[0], []) == [tuple(round(x, 6) for x in r) for r in dense(items, q, 0.4)[:3]]


def test_frequent_and_rare_words_are_summed_alike(monkeypatch):
    """Sums by word are bitwise those made at once: equal items must have equal scores."""
    rng = random.Random(5)
    words = [f"w{n}" for n in range(40)]
    rows = []
    for i in range(200):
        own = sorted({w for n, w in enumerate(words) if rng.random() < 2 / (n + 1)})
        rows.append({"id": i, "allowed": [], "words": own, "tfs": [rng.randint(1, 5) for _ in own], "length": len(own), "avg_length": 9.5})
    given = pa.Table.from_pylist(rows, schema=pa.schema([("id", pa.int64()), ("allowed", pa.list_(pa.int64())), ("words", pa.list_(pa.string())), ("tfs", pa.list_(pa.int64())), ("length", pa.int64()), ("avg_length", pa.float64())]))
    asked = [{"query_id": q, "filter_no": None, "words": (some := rng.sample([*words, "none"], q % 9)), "idfs": [rng.random() for _ in some], "n_terms": 1.0} for q in range(30)]
    queries = blocks.QueryBlock.of(pa.Table.from_pylist(asked, schema=pa.schema([("query_id", pa.int64()), ("filter_no", pa.int64()), ("words", pa.list_(pa.string())), ("idfs", pa.list_(pa.float64())), ("n_terms", pa.float64())])))
    block, every = blocks.ItemBlock(given), (np.arange(30), np.arange(200))
    at_once, _ = blocks.WordScores(block, queries).of(*every)
    monkeypatch.setattr(blocks, "_FEW_ITEMS", 0)
    by_word, _ = blocks.WordScores(block, queries).of(*every)
    assert block._dense and at_once.any() and np.array_equal(at_once, by_word)
