"""Spelling variants against a brute-force version."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from shortlist.llm import spelling


def edits_one(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= 3}
    near = {w: [v for v in n if edits_one(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus(seed=1, docs=250):
    rng = random.Random(seed)
    stems = ["wander", "wonder", "wounder", "étrange", "größeren", "aaaaa", "aaaaaa", "aaaaab", "abababab", "ÀÈÌÒÙà"]
    words = list(stems)
    for s in stems:
        for _ in range(14):
            i, c = rng.randrange(len(s)), rng.choice("abenzéü")
            words.append(rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :], s.upper()]))
    weights = [1 / (1 + k) for k in range(len(words))]
    return [(d, " ".join(rng.choices(words, weights, k=40)) + ", Wander-wander x×÷y") for d in range(docs)]


def test_variants_match_brute_force(spark, docs_of):
    rows = corpus()
    want = plain(rows)
    assert len(want) > 60 and any(r[1] and r[2] != r[1] for r in want)
    assert got(spelling.variants(docs_of(rows))) == want


def test_small_cells_change_nothing(spark, docs_of, monkeypatch):
    rows = corpus(seed=2, docs=120)
    monkeypatch.setattr(spelling, "CELL_BYTES", 3000)
    assert got(spelling.variants(docs_of(rows))) == plain(rows)


def test_odd_rows(spark, docs_of, odd):
    long = "b" * 6000
    rows = [(1, None), (2, ""), (None, "wonder wonder wonder"), (3, f"{long} {long}b {long}"), (3, f"{long} {long}b {long}b"), (4, "ŧŧŧŧŧŧ 中文中文中文 x"), (5, "wonders " * 6)]
    assert got(spelling.variants(docs_of(rows))) == plain(rows)
    assert got(spelling.variants(odd)) == plain([(r.doc_id, r.text) for r in odd.collect()])
    empty = spelling.variants(docs_of([]))
    assert empty.collect() == [] and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("size", [5, 6, 9])
def test_pairs_of_a_product(size):
    rng = random.Random(size)
    left = sorted({"".join(rng.choices("abc", k=size)) for _ in range(60)})
    for more in (0, 1):
        right = sorted({"".join(rng.choices("abc", k=size + more)) for _ in range(70)})
        i, j = spelling.near_pairs(left, right)
        want = {(a, b) for a, x in enumerate(left) for b, y in enumerate(right) if edits_one(x, y)}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
