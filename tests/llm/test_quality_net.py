"""The quality network: sums and features by hand, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shortlist.llm import quality_net as net

SF = "/root/testdata/sf0.01"


def contexts(texts):
    """Context sums by loops over tokens."""
    index = net.index_vectors()
    sums, n = {}, {}
    for text in texts:
        buckets, _ = net.TokenBuckets().of([text or ""])
        for t, b in enumerate(buckets.tolist()):
            near = [u for u in range(t - net.WINDOW, t + net.WINDOW + 1) if u != t and 0 <= u < len(buckets)]
            sums[b] = sums.get(b, np.zeros(net.DIM, np.int64)) + sum((index[buckets[u]].astype(np.int64) for u in near), np.zeros(net.DIM, np.int64))
            n[b] = n.get(b, 0) + 1
    return {b: (n[b], sums[b].tolist()) for b in sums}


def texts_of(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "cat", "sat", "Ünder", "42", "!!", "a_b", "中文", "x.y"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 30))) for _ in range(n)] + [None, "", "one"]


def test_context_sums(spark, docs_of, monkeypatch):
    texts = texts_of(1)
    rows = docs_of(list(enumerate(texts))).repartition(3)
    want = contexts(texts)
    for size in (net._TOKENS_AT_ONCE, 7):
        monkeypatch.setattr(net, "_TOKENS_AT_ONCE", size)
        got = {r.bucket: (r.n, list(r.sums)) for r in net.context_table(rows).collect()}
        assert got == want


def test_features(spark, docs_of, monkeypatch):
    texts = [t or "" for t in texts_of(2)]
    words = net.WordVectors.of(net.context_table(docs_of(list(enumerate(texts)))))
    whole = words.features(texts, net.TokenBuckets())
    monkeypatch.setattr(net, "_TOKENS_AT_ONCE", 5)
    assert np.allclose(words.features(texts, net.TokenBuckets()), whole, atol=1e-5)
    for text, row in zip(texts, whole):
        b, _ = net.TokenBuckets().of([text])
        if not len(b):
            assert not row.any()
            continue
        v, w = words.vectors[b].astype(float), words.weights[b].astype(float)
        follows = [(v[t] @ v[t - 1], b[t] == b[t - 1]) for t in range(1, len(b))]
        want = [*v.mean(0), *((v * w[:, None]).sum(0) / w.sum()), sum(c for c, _ in follows) / len(b), sum(s for _, s in follows) / len(b), len(set(b.tolist())) / len(b), np.log1p(len(b))]
        assert np.allclose(row, want, atol=1e-5)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    p = 1 / (1 + np.exp(-(2 * x[:, 0] * x[:, 1] + x[:, 2])))
    y = (rng.random(4000) < p).astype(float)
    model = net.Network(0.5, net.train(x[:1500], y[:1500]))
    model = net.Network(0.5, model.weights, net.calibrated(model, x[1500:2500], y[1500:2500]))
    raw, score = net.Network(0.5, model.weights).scores(x[2500:]), model.scores(x[2500:])
    loss = [-np.mean(np.log(np.where(y[2500:] == 1, s, 1 - s))) for s in (raw, score)]
    assert loss[1] <= loss[0] + 0.005
    assert ((score > 0.5) == (p[2500:] > 0.5)).mean() > 0.85
    assert abs(score.mean() - y[2500:].mean()) < 0.05


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = net.score_documents(docs, labels)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == docs.count() and rows.columns == ["doc_id", "held_out", "score", "predicted"]
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert len(held) > 60
    assert np.mean([q == p for q, p in held]) > 0.93


def test_labels_that_may_be_learnt_from(spark, docs_of):
    """Held-out labels, repeated rows and other columns change nothing."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["good", "fine", "words"] if i % 3 else ["$$$", "spam", "###"], k=20))) for i in range(300)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(300)]
    schema = "doc_id long, quality int, toxic int"

    def scores(r, known):
        return {x.doc_id: x.score for x in net.score_documents(docs_of(r), spark.createDataFrame(known, schema)).collect()}

    want = scores(rows, labels)
    assert min(want[i] for i in want if i % 3) > max(want[i] for i in want if not i % 3)
    held = {i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0}
    wrong = [(i, 1 - q if i in held else q, 1) for i, q, _ in labels]
    got = scores(rows, wrong + wrong[:50] + [(None, 0, 0), (7, None, 0), (9999, 0, 0)])
    assert got == pytest.approx(want, abs=1e-4)


def test_odd_rows(spark, odd, docs_of):
    labels = spark.createDataFrame([(5, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false")):
        got = net.score_documents(odd, known).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd.collect())
        assert all(0 <= r.score <= 1 and r.held_out is not None for r in got)
    assert net.score_documents(docs_of([]), labels).collect() == []
