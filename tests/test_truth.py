"""The expected items of the benchmark passages, on tables of its own."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from workload import views


def test_only_texts_with_a_word_of_a_passage_are_shuffled(spark, tmp_path):
    texts = [(n, f"some filler text number {n}") for n in range(20)]
    texts += [(20, "he said the uncommonword again twice"), (21, "uncommonword but no passage"), (20, "the uncommonword again"), (19, "uncommonword again"), (22, None)]
    tables = {
        "documents": (texts, "doc_id long, text string"),
        "benchmark": ([(1, "the uncommonword again"), (2, None), (3, "the uncommonword again")], "item_id long, text string"),
        "part": ([(n, f"name {n}", "b", "SMALL", n) for n in range(23)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int"),
        "pages": ([(20, "u/20")], "page_id long, url string"),
        "embeddings": ([(20, [1.0])], "vec_id long, embedding array<float>"),
        "labels": ([(20, 1)], "doc_id long, quality int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = views.truth(spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "u/20"), (3, "u/20")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join LeftSemi[^\n]*strategy=broadcast", plan), plan
    assert found.where(F.col("url").isNull()).isEmpty()
