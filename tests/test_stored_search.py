"""Searches over postings stored by term and items stored by cell."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from shortlist.operators import lexical, postings, stored_cells
from shortlist.operators import vector_search as vec
from shortlist.operators.index import build_index, filter_rows
from shortlist.operators.queries import Limits, query_table
from shortlist.schemas import CATALOG
from shortlist.session import shared_folder
from tests.test_search import NOTHING, QUERY, plan_of, random_case

SF = "/root/testdata/sf0.01"


def result(df):
    score = next(c for c in df.columns if c.endswith("_score"))
    return sorted((r.query_id, r["rank"], r.id, round(r[score], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def case(spark):
    items, asked = random_case(n_items=150, n_queries=15, seed=5)
    return spark.createDataFrame(items, CATALOG), spark.createDataFrame(asked, QUERY)


@pytest.fixture(scope="module")
def stored(case):
    index = build_index(case[0])
    return postings.store_postings(index, buckets=8, block_items=4)


@pytest.mark.parametrize("limits", [Limits(), NOTHING])
@pytest.mark.parametrize("require_all", [True, False])
def test_postings_give_the_same_search(case, stored, limits, require_all):
    want = result(lexical.search_lexical(case[1], stored.index, k=3, require_all=require_all))
    got = result(postings.search_postings(case[1], stored, k=3, require_all=require_all, limits=limits))
    assert got == want and got


def test_only_buckets_of_the_terms_are_read(spark, stored):
    queries = spark.createDataFrame([(1, "java coding")], "query_id long, text string")
    table = query_table(queries)
    wanted = postings.wanted_terms(table, stored)
    bounds = postings.block_bounds(table, stored, wanted, True)
    plan = plan_of(bounds)
    assert "dynamicpruning" in plan and "weights" not in plan
    scored = plan_of(postings.block_scores(bounds, table, stored, wanted, True))
    assert "dynamicpruning" in scored
    # Buckets of the index that no term has are not met.
    assert wanted.select("bucket").distinct().count() < stored.blocks.select("bucket").distinct().count()


def test_blocks_that_cannot_reach_the_bound_are_dropped(spark):
    rng = random.Random(2)
    rows = []
    for i in range(2000):
        words = ["rare"] * (8 if i % 400 == 7 else 1) + [rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 60))]
        rows.append((i, "x", f"u/{i}", None, " ".join(words), None, None, None, None, None))
    index = build_index(spark.createDataFrame(rows, CATALOG))
    stored = postings.store_postings(index, block_items=20)
    queries = spark.createDataFrame([(1, "rare"), (2, "rare aaa"), (3, "nothing known"), (4, "")], "query_id long, text string")
    table = query_table(queries)
    wanted = postings.wanted_terms(table, stored)
    bounds = postings.block_bounds(table, stored, wanted, False)
    first = postings.first_blocks(bounds)
    found = lexical.ranked(postings.block_scores(first, table, stored, wanted, False), "raw", 5)
    left = postings.reachable(bounds, first, found, 5)
    counts = {r.query_id: r["count"] for r in bounds.groupBy("query_id").count().collect()}
    kept = {r.query_id: r["count"] for r in left.groupBy("query_id").count().collect()}
    assert counts[1] > 90 and kept.get(1, 0) < counts[1] / 2
    for every in (True, False):
        want = result(lexical.search_lexical(queries, index, k=5, require_all=every))
        assert result(postings.search_postings(queries, stored, k=5, require_all=every)) == want


def test_empty_catalog_and_empty_queries(spark, stored):
    none = spark.createDataFrame([], CATALOG)
    empty = postings.store_postings(build_index(none))
    queries = spark.createDataFrame([(1, "java"), (2, None)], "query_id long, text string")
    assert postings.search_postings(queries, empty).collect() == []
    assert postings.search_postings(queries.limit(0), stored).collect() == []
    assert {r.query_id for r in postings.search_postings(queries, stored).collect()} == {1}


def test_dropped_postings_and_cells_leave_no_files(spark, case, stored):
    name = "dropped_postings"
    postings.store_postings(stored.index, name)
    folder = f"{shared_folder(spark)}/{name}"
    assert os.path.isdir(folder)
    postings.drop_postings(spark, name)
    assert not os.path.exists(folder) and not spark.catalog.tableExists(f"{name}_postings")
    hot = filter_rows(case[0]).withColumn("cell", F.lit(0))
    stored_cells.store_cells(hot, vec.cell_centroids(hot), "dropped_cells")
    stored_cells.drop_cells(spark, "dropped_cells")
    assert not os.path.exists(f"{shared_folder(spark)}/dropped_cells")


@pytest.mark.parametrize("limits", [Limits(), NOTHING])
def test_stored_cells_give_the_same_search(case, limits):
    cells, centroids = vec.build_cells(filter_rows(case[0]), 6)
    kept = stored_cells.store_cells(cells, centroids)
    want = result(vec.search_cells(case[1], cells, centroids, n_probe=2, k=4))
    assert result(stored_cells.search_stored_cells(case[1], kept, 2, k=4, limits=limits)) == want and want
    exact = result(vec.search_vector(case[1], filter_rows(case[0]), k=4))
    assert result(stored_cells.search_stored_cells(case[1], kept, 6, k=4, limits=limits)) == exact


def test_files_read_fall_with_the_probes(spark, case):
    cells, centroids = vec.build_cells(filter_rows(case[0]), 6)
    kept = stored_cells.store_cells(cells, centroids)
    one = case[1].where("vector is not null and filters is null").limit(1)
    read = {}
    for n_probe in (1, 3, 6):
        probes = vec.probed_cells(one, kept.centroids, n_probe)
        here = stored_cells.probed_items(kept, probes)
        assert "dynamicpruning" in plan_of(here)
        read[n_probe] = here.select(F.input_file_name().alias("file")).distinct().count()
    assert read[1] < read[3] < read[6]
    found = stored_cells.search_stored_cells(one, kept, 2)
    assert "dynamicpruning" in plan_of(found) and plan_of(found).count("CartesianProduct") == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_cells(spark):
    """Recall of ``search_vector_kmeans``'s setting against exact search."""
    from workload import views

    queries = views.search_queries(spark, SF)
    cells, centroids = vec.build_cells(views.items(spark, SF), views.KMEANS_CELLS)
    kept = stored_cells.store_cells(cells, centroids)
    found = {(r.query_id, r.id) for r in stored_cells.search_stored_cells(queries, kept, views.KMEANS_PROBES).collect()}
    exact = {(r.query_id, r.id) for r in vec.search_vector(queries, views.items(spark, SF)).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_postings_are_grouped_where_items_are_cut(stored):
    """Items are shuffled by block; their exploded postings are not."""
    plan = plan_of(postings.term_blocks(stored.index, 4))
    assert "hashpartitioning(block" in plan and "hashpartitioning(term" not in plan
