"""Quality rules and the near-duplicate join against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import ODD
from pyspark.sql import functions as F

from shortlist.llm import quality
from shortlist.llm.graph import components
from shortlist.llm.ngram_join import choose_bands, near_duplicates
from shortlist.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def measures(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    runs = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = set()
    for i in range(len(words) - 4):
        if runs[tuple(words[i : i + 5])] > 1:
            repeated |= set(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(repeated)


SHAPES = [
    "a b c d e a b c d e f",
    "x\ny\nx\n \n\n\x0b\nx",
    "a a a a a a a",
    "one\x0btwo\x0cthree\rfour\x85five\xa0six #$% ü😀",
    "\n\n\n",
    "a b c d e\nf g h i j a b c d e",
]


def test_measures():
    texts = SHAPES + [t or "" for _, t in ODD]
    got = list(zip(*(c.tolist() for c in quality.measure_texts(texts))))
    assert got == [measures(t) for t in texts]
    assert [len(c) for c in quality.measure_texts([])] == [0] * 6


def test_exact_binomial_test():
    exact = sum(math.comb(50, i) * 0.1**i * 0.9 ** (50 - i) for i in range(3))
    assert quality.at_most_chance(2, 50, 0.1) == pytest.approx(exact)
    assert quality.certified([0, 0, 3, 0], 300, 0.02, 0.05) == 2
    assert quality.certified([0], 10, 0.02, 0.05) == 0
    assert quality.certified([], 10, 0.02, 0.05) == 0


def labelled(spark, n=3000):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [rng.choice("alpha beta gamma delta omega sigma".split()) + str(rng.randrange(999)) for _ in range(30)]
        if not good:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words), "en" if i % 50 else None))
        labels.append((i, int(good)))
    labels += [(0, None), (None, 1), (10**9, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_cutoffs_reject_bad_and_spare_good(spark):
    docs, labels = labelled(spark)
    measured = quality.store(quality.with_measures(docs, ["lang"]))
    cutoffs, n = quality.fit_cutoffs(measured, labels)
    assert n == 2
    by = {r.quality_stratum: r for r in cutoffs.collect()}
    assert by['{"lang":"en"}'].symbols is not None and by['{"lang":"en"}'].long_words is None
    # Too few labelled documents to certify anything.
    assert by["{}"].symbols is None
    kept = {r.doc_id: r.kept for r in quality.judge(measured, cutoffs, n).collect()}
    assert all(kept[i] for i in kept if i % 3 > 0)
    assert not any(kept[i] for i in kept if i % 3 == 0 and i % 50)
    assert all(kept[i] for i in kept if i % 50 == 0)


def test_repeated_rows_count_once(spark):
    """A table repeated 300 times certifies what the table alone does."""
    docs, labels = labelled(spark, 150)
    many = docs.crossJoin(spark.range(300).select(F.lit(1).alias("copy")))
    got = []
    for table in (docs, many):
        measured = quality.store(quality.with_measures(table, ["lang"]).drop("text"))
        got.append(sorted(map(str, quality.fit_cutoffs(measured, labels)[0].collect())))
    assert got[0] == got[1] and "n_good=98" in str(got[0])


def test_all_rules_share_one_test(spark):
    rows, labels = [], []
    for i in range(900):
        good = i % 3 > 0
        words = [f"w{i}x{j}" for j in range(100)]
        n = 45 if not good else 6 if i % 30 == 1 else 0
        rows.append((i, " ".join(["#" + w for w in words[:n]] + words[n:]), "ab"[i % 2]))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = quality.store(quality.with_measures(docs, ["lang"]))
    cutoffs, n = quality.fit_cutoffs(measured, spark.createDataFrame(labels, "doc_id long, quality int"))
    # 300 good labels a stratum: enough for one test with the whole risk, not for five.
    assert n == 2 and [(r.n_good, r.symbols, r.repeats) for r in cutoffs.collect()] == [(300, 0.4, None)] * 2
    assert {r.doc_id for r in quality.judge(measured, cutoffs, n).where("kept").collect()} == {i for i in range(900) if i % 3}


def test_path_follows_bad_documents():
    none = [len(g) for g in quality.GRIDS.values()]
    at = np.array([[4, *none[1:]], [9, *none[1:]], [none[0], 2, *none[2:]], none])
    path = quality.bad_path(at, np.array([5, 1, 3, 7]))
    assert path == [[5, 0, 0, 0, 0], [5, 3, 0, 0, 0], [10, 3, 0, 0, 0]]
    assert quality.bad_path(at[:0], np.array([])) == []


def test_quality_of_odd_rows(spark, odd):
    docs = odd.withColumn("kept", F.lit("clash")).withColumn("quality_measures", F.lit(1))
    measured = quality.store(quality.with_measures(docs, ["lang"]))
    none = spark.createDataFrame([], "doc_id long, quality int")
    cutoffs, n = quality.fit_cutoffs(measured, none)
    rows = quality.judge(measured, cutoffs, n).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        m = measures(r.text)
        assert tuple(r.quality_measures) == m
        failed = m[0] < 10 or 100 * m[5] > 20 * m[0]
        assert r.base_failed == failed and r.kept == (not failed)
    empty = quality.store(quality.with_measures(docs.limit(0), ["lang"]))
    assert quality.judge(empty, *quality.fit_cutoffs(empty, none)).count() == 0


def test_quality_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op8_quality"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r, m = rows[d.doc_id], measures(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (*m[:3], *m[4:])


def shingles(text):
    words = words_of(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows, similarity=0.8):
    """(class, links) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return [(d, least[find(i)], links[i]) for i, (d, _) in enumerate(rows)]


def near_copies(n, words, changed, seed, first=0):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    rows = []
    for i in range(n):
        text = list(base)
        for at in rng.sample(range(words), changed):
            text[at] = f"z{rng.randrange(10**6)}"
        rows.append((first + i, " ".join(text)))
    return rows


def test_join_against_all_pairs(docs_of):
    rows = near_copies(30, 300, 3, 1) + near_copies(30, 200, 4, 2, 100) + near_copies(20, 60, 6, 3, 200)
    rows += [(300 + i, "short text") for i in range(4)] + [(310, ""), (311, None), (312, " \n ")]
    rows += [(400 + i, f"single {i} " * 20) for i in range(10)]
    got = sorted(tuple(r) for r in near_duplicates(docs_of(rows)).collect())
    want = sorted(brute(rows))
    assert [g[0] for g in got] == [w[0] for w in want]
    # Bands may miss a pair at the very threshold; the groups here are well inside.
    assert [g[:2] for g in got if g[0] < 200 or g[0] >= 300] == [w[:2] for w in want if w[0] < 200 or w[0] >= 300]
    assert sum(g[2] for g in got) >= 0.98 * sum(w[2] for w in want)
    assert all(g[2] <= w[2] for g, w in zip(got, want))


def test_large_cells_are_cut_into_blocks(docs_of, monkeypatch):
    from shortlist.llm import ngram_join

    rows = near_copies(90, 100, 1, 5) + [(500, near_copies(1, 100, 1, 5)[0][1])]
    whole = sorted(tuple(r) for r in near_duplicates(docs_of(rows)).collect())
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "COLUMNS", 64)
    assert sorted(tuple(r) for r in near_duplicates(docs_of(rows)).collect()) == whole
    assert whole == sorted(brute(rows))


def test_join_of_odd_rows(docs_of, odd):
    got = sorted(map(str, map(tuple, near_duplicates(odd).collect())))
    known = [r for r in ODD if r[0] is not None]
    assert got == sorted(map(str, [*brute(known), (None, None, 0)]))
    assert near_duplicates(docs_of([])).count() == 0


def test_join_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in QUERIES["op9_ngram_join"](spark, SF).collect())
    assert got == sorted(brute(docs))


def test_bands_reach_the_recall():
    for similarity, recall in ((0.8, 0.99), (0.5, 0.9), (0.9, 0.999)):
        bands, rows = choose_bands(similarity, recall)
        assert bands * rows <= 256 and 1 - (1 - similarity**rows) ** bands >= recall
    with pytest.raises(ValueError):
        choose_bands(0.01, 0.9999)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (7, 7)]
    edges += [(int(a), int(b)) for a, b in rng.integers(300, 360, (40, 2))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {i: i for e in edges for i in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
