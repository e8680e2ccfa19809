"""Personal data against the plain patterns, and the pipeline as a whole."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import tracemalloc
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from llm_cases import ODD
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shortlist.llm import pii
from shortlist.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            fine = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), list(PLAIN).index(kind), m.end()))
    return sorted(out)


CASES = [
    "mail a.b+c@x-y.example.com, or @no.com a@b c@d.e@f.g.h",
    "a@@b.c x@y..z q@-.-.",
    "1.2.3.4.5.6.7.8 256.1.1.1 01.002.0003.255 1.2.3 999.1.2.3.4",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111  1111",
    "+1 (988) 555-2485 +12 +1((((((((2 +123456789012345678 +1 2 3 4 5 6 7 8 9)",
    "ü😀 x@y.zz ü +49 30 1234567",
    "٣.٤.٥.٦ ４111",
    "%" * 50 + "@" + "a." * 20,
    "a" * 50_000 + " " + "1" * 50_000 + " " + "1." * 20_000 + "@" * 2000 + "+1" * 2000,
]


def test_base_spans():
    for text in CASES[:-1]:
        assert pii.base_spans(text) == plain_spans(text), text
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice("a1@. +-()2%") for _ in range(rng.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text), text
    pii.base_spans(CASES[-1])  # ends soon


SAME = "call +1 (988) 555-2485 now. Later again (988) 555-2485 please, or write joe.smith42@mail.example.com; joe.smith42 answers. Room 42, year 1999, 12345678."


def fitted(spark, docs_of):
    rows = [(i, f"x +1 ({100 + i}) 555-{1000 + i} y n{i}a z and jo{i}.x{i}@m.example.com, {i} {i % 7}a") for i in range(200)]
    return pii.fit(docs_of(rows))


def test_distant_repeats_get_the_same_label(spark, docs_of):
    model = fitted(spark, docs_of)
    base = pii.base_spans(SAME)
    added = [(pii.KINDS[k], SAME[a:b]) for a, k, b in pii.added_spans(SAME, base, model)]
    assert ("phone", "988) 555-2485") in added or ("phone", "(988) 555-2485") in added or ("phone", "555-2485") in added
    assert all("1999" not in t and "12345678" not in t and t != "42" for _, t in added)
    clean = SAME.replace("+", "").replace("@", " at ")
    assert pii.added_spans(clean, pii.base_spans(clean), model) == []
    assert pii.redact("a x@y.zz b", pii.base_spans("a x@y.zz b")) == "a <EMAIL> b"


def test_numbers_in_groups_are_repeats(spark, docs_of):
    model = fitted(spark, docs_of)
    phone, card = "+1 (017) 555-7713", "4111 1111 1111 1111"
    forms = ["017-555-7713", "(017)555-7713", "0175557713", "(017) 555 7713", "1 017 555 7713", "001 (017) 555-7713", "555 7713"]
    forms = [(phone, "phone", f) for f in forms] + [("+49 (0)30 1234567", "phone", f) for f in ("030 1234567", "0049 30 1234567")]
    forms += [("+10175557713", "phone", "(017) 555 7713"), (card, "card", card + " 12"), (card, "card", "4111-1111 1111 1111 12")]
    for seen, kind, form in forms:
        text = f"Ask for {seen} first. In 1999 room 42 had 9876543 or 12 34 56 78 things. " + f"Then {form}, it says. " * 40
        added = pii.added_spans(text, pii.base_spans(text), model)
        digits = lambda t: re.sub("[^0-9]", "", t)
        want = digits(form).lstrip("0").removesuffix("12" if kind == "card" else "-")
        found = [digits(text[a:b]) for a, k, b in added if pii.KINDS[k] == kind]
        assert len(found) == len(added) == 40 and all(want in f for f in found), (form, found)
    assert pii.number_keys(2, card) == {"4111111111111111"}
    long = phone + " " + "1 " * 20_000 + "0 " * 20_000 + "5" * 20_000
    assert pii.numbers_of(long, pii.base_spans(phone), pii.tokens_of(long, pii.base_spans(phone))) == []


def test_field_counts_all_texts(spark, docs_of):
    rows = [(i, f"x n{i}a y") for i in range(4500)] + [(i, "12345-67(89) rare") for i in range(4500, 4600)]
    counts = defaultdict(int)
    for _, text in rows:
        for at, end, _ in pii.tokens_of(text, []):
            counts[pii.shape(text[at:end])] += 1
    model = pii.fit(docs_of(rows))
    assert {k: round(math.exp(v[0]), 9) for k, v in model.items()} == {
        "s" + k: round((1 + n) / (1.8 + n), 9) for k, n in counts.items()
    }


def test_odd_rows(spark, odd, docs_of):
    model = pii.fit(odd)
    rows = odd.withColumn("found", pii.personal_data(F.col("text"), model, with_text=True)).collect()
    assert len(rows) == len(ODD)
    assert all(r.found.redacted == (r.text or "") and r.found.spans == [] for r in rows)
    assert pii.fit(docs_of([])) == {}
    empty = docs_of([]).withColumn("found", pii.personal_data(F.col("text"), {}))
    assert empty.count() == 0


def test_pii_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op7_pii"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        spans, r = plain_spans(d.text), rows[d.doc_id]
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, tables = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        tables = stage(spark, tables, SF)
        assert tables.columns == docs.columns and tables.dtypes == docs.dtypes
        tables = spark.createDataFrame(tables.collect(), tables.schema)
        steps.append(tables.collect())
    kept = {r.doc_id for r in QUERIES["op8_quality"](spark, SF).where("kept").collect()}
    assert {r.doc_id for r in steps[0]} == kept
    assert {r.doc_id for r in steps[1]} <= kept and len({r.text for r in steps[1]}) == len(steps[1])
    assert all(not plain_spans(r.text) and r.n_chars == len(r.text) for r in steps[2])
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    sizes = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        sizes[r.doc_id] += r.length
    assert sizes == {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) + 1 for r in steps[2]}


def test_pipeline_of_odd_rows(spark, odd, docs_of):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs_of([(i, " ".join(f"w{i}n{j}" for j in range(30))) for i in range(20, 23)]).select(*docs.columns))
    clashing = ("kept", "base_failed", "text_hash", "redacted", "first", "first_hash", "quality_measures", "whole_row")
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in clashing})
    for table in (docs, docs.limit(0)):
        some = table.limit(1).count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
            rows = table.collect()
            assert table.columns == docs.columns
            for r in rows:
                assert all(r[c] == (None if r.doc_id is None else f"{c} of {r.doc_id}") for c in clashing)
            assert {20, 21, 22} <= {r.doc_id for r in rows} or not some
            table = spark.createDataFrame(rows, table.schema)
        pieces = corpus_pipeline.pack(spark, table, SF).collect()
        assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}


def test_copies_under_a_repeated_id(spark, docs_of):
    x, y, z = ("".join(f"{c}{i} " for i in range(50)) for c in "xyz")
    rows = [(0, y), (1, x), (1, y), (2, z), (2, z), (2, x), (None, z), (None, z), (3, None)]
    docs = docs_of(rows)
    want = [(0, y), (1, x), (2, z), (3, None), (None, z), (None, z)]
    for table in (docs, docs.orderBy(F.desc("text")), docs.repartition(5)):
        kept = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, table, SF).collect()]
        assert sorted(kept, key=str) == sorted(want, key=str)


def test_messages_against_exact_sums():
    """On a field without loops the messages give the exact label probabilities."""
    rng = np.random.default_rng(4)
    unary, pair, hubs = rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), rng.normal(size=(2, 5))
    # 0-1-2 and 3-4 are neighbours; the hubs join 0 and 3, and 4 alone.
    edges, groups = [1, 2, 4], [(0, 0, pii.SKIP), (3, 0, pii.SKIP), (4, 1, 2.0)]
    total = np.zeros((5, 5))
    for labels in itertools.product(range(5), repeat=7):
        score = sum(unary[i, labels[i]] for i in range(5)) + sum(hubs[h, labels[5 + h]] for h in range(2))
        score += sum(pair[labels[i - 1], labels[i]] for i in edges)
        score += sum(x for i, h, x in groups if labels[i] == labels[5 + h])
        for i in range(5):
            total[i, labels[i]] += math.exp(score)
    node, hub, strength = (np.array(c) for c in zip(*groups))
    found = pii._messages(unary, np.array(edges), (node, hub, strength), pair, hubs)
    assert np.abs(found - total / total.sum(1, keepdims=True)).max() < 0.01


def test_memory_of_a_text_with_many_repeats():
    """A text with 120,000 repeats takes less than 200 MB."""
    part = "jo.smith1@x jo.smith +1 (017) 555-7713, 0175557713, "
    text = "jo.smith@mail.example.org " + part * 30_000
    base = pii.base_spans(text)
    model = {"s10": [math.log(0.2)] * 5, "s0.a": [math.log(0.2)] * 5}
    tracemalloc.start()
    added = pii.added_spans(text, base, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 1_400_000 and peak < 200 << 20
    kinds = [pii.KINDS[k] for _, k, _ in added]
    assert kinds.count("phone") >= 30_000
