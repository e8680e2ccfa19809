"""URL filter, views of dialogues, archives and nearest neighbours on odd rows."""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import functions as F

from shortlist.llm import ann, url_filter, warc
from shortlist.llm.chat import END, PART_TURNS, START, perspectives
from shortlist.llm.queries import RULES
from shortlist.llm.storage import new_folder

PAGES = "page_id long, url string, html string, host string, block long, w0 long, mark string, first long"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 1, "m", 1) for i, u, h in rows], PAGES)


URLS = [
    (1, "https://A.Example.NET/en/x?b=2&a=1&utm_source=q#f", ("a.example.net", "/en/x", "example.net/en/", "allow")),
    (2, "http://example.net", ("example.net", "", None, "allow")),
    (3, "http://example.net/", ("example.net", "/", "net/", "block")),
    (4, "http://example.com/de/1", ("example.com", "/de/1", "example.com/de/", "block")),
    (5, "http://badexample.com/de/1", ("badexample.com", "/de/1", None, "allow")),
    (6, None, ("", "", None, "allow")),
    (7, "no scheme", ("", "", None, "allow")),
    (8, "http://www.Listed.com/p/?z=1#top", ("www.listed.com", "/p/", None, "block")),
    (8, "https://listed.com/p?utm_x=1&z=1", ("listed.com", "/p", None, "block")),
    (9, "https://listed.com/p", ("listed.com", "/p", None, "allow")),
    (10, "x://y.org/fr/\n?q", ("y.org", "/fr/\n", "org/fr/", "allow")),
    (None, "a://b://c/d", ("b:", "//c/d", None, "allow")),
    (11, "http://É.net?x/y", ("É.net", "", None, "allow")),
    (12, "http://" + "h" * 50_000 + "/" + "p" * 50_000, ("h" * 50_000, "/" + "p" * 50_000, None, "allow")),
]


def test_url_verdicts(spark):
    listed = spark.createDataFrame([("listed.com/p?z=1",), (None,), ("listed.com/p?z=1",)], "canonical string")
    pages = pages_of(spark, [(i, u, "") for i, u, _ in URLS])
    got = url_filter.filter_urls(pages, RULES, listed).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for i, _, w in URLS)
    none = listed.limit(0)
    assert {r.verdict for r in url_filter.filter_urls(pages, [], none).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), RULES, listed).count() == 0


def test_filter_lets_few_others_through(spark):
    urls = spark.range(20_000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    blocks, n = url_filter.bloom_blocks(urls, 20_000)
    assert n & (n - 1) == 0 and n <= url_filter.MAX_BLOCKS
    table = {r.block: [r[f"w{i}"] for i in range(8)] for r in blocks.collect()}

    def passed(df):
        bits = [b.alias(f"b{i}") for i, b in enumerate(url_filter._bits(F.col("canonical")))]
        rows = df.select(url_filter._block(F.col("canonical"), n).alias("block"), *bits).collect()
        return [r.block in table and all(table[r.block][i] >> r[f"b{i}"] & 1 for i in range(8)) for r in rows]

    assert all(passed(urls))
    others = spark.range(20_000).select(F.concat(F.lit("g/"), "id").alias("canonical"))
    assert np.mean(passed(others)) < 0.02


def test_views_by_a_loop(spark):
    rows = [(1, i, ("ann", "bob", "system", None)[i % 4], f"t{i} é") for i in range(PART_TURNS + 44)]
    rows += [(1, 7, "ann", "again"), (1, 7, "ann", "again"), (2, None, "ann", None), (2, 0, "bob", "<|im_end|> hi")]
    rows += [(3, 0, "system", "alone"), (None, 0, "ann", "lost"), (4, 1, "ann", "x" * 30_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, at string, part long")
    got = {(r.conv_id, r.speaker, r.part): r for r in perspectives(table).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        turns = [(t is not None, t or 0, r or "unknown", x or "") for c, t, r, x in rows if c == conv]
        turns.sort()
        for speaker in {t[2] for t in turns} - {"system"}:
            for part in range(0, len(turns), PART_TURNS):
                text, mask = "", []
                for _, _, role, words in turns[part : part + PART_TURNS]:
                    mine = role == speaker
                    text += START + ("assistant" if mine else "system" if role == "system" else f"user name={role}") + "\n"
                    start = len(text)
                    text += words.replace("<|", "< |") + END
                    if mine:
                        mask.append((start, len(text)))
                want[conv, speaker, part // PART_TURNS] = (text, mask)
    assert {k: (r.text, [(m.start, m.end) for m in r["mask"]]) for k, r in got.items()} == want
    assert all(r.n_learnt == sum(m.end - m.start for m in r["mask"]) for r in got.values())
    assert perspectives(table.limit(0)).count() == 0


PAYLOADS = [
    (3, "http://x/\r\ny", "<p>same ü</p>"),
    (1, "u1", "<p>same ü</p>"),
    (2, None, ""),
    (5, "u5", None),
    (1, "u1", "<p>same ü</p>"),
    (None, "u", "only null"),
    (None, "u", "<p>same ü</p>"),
    (7, "u7", "Content-Length: 3\r\n\r\n" * 40_000),
    (8, "u8", "line\r\n\r\nWARC/1.1\r\n"),
]


def test_archives_round_trip(spark):
    folder = new_folder(spark, "w")
    index = warc.write_bundles(warc.plan_records(pages_of(spark, PAYLOADS)), folder)
    got = warc.read_bundles(index, folder).collect()
    want = []
    for i, url, html in PAYLOADS:
        data = (html or "").encode()
        ids = [p[0] for p in PAYLOADS if (p[2] or "").encode() == data and p[0] is not None]
        refers = min(ids) if ids and min(ids) != i else None
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        kind = "response" if refers is None else "revisit"
        block = b"" if refers is not None else data
        want.append((i, kind, len(data), digest, refers, url and url.replace("\r\n", "%0D%0A"), block))
    assert sorted(map(str, want)) == sorted(str((*tuple(r)[:6], bytes(r.payload))) for r in got)
    some = warc.fetch_records(index, spark.createDataFrame([(7,), (8,), (99,)], "page_id long"), folder).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in some) == [p[::2] for p in PAYLOADS[-2:]]
    assert {r.record_type for r in warc.plan_records(pages_of(spark, PAYLOADS), least=10**6)
            .select(F.when(F.col("refers_to").isNull(), "response").alias("record_type")).collect()} == {"response"}
    empty = new_folder(spark, "w")
    nothing = warc.write_bundles(warc.plan_records(pages_of(spark, [])), empty)
    assert warc.read_bundles(nothing, empty).count() == 0


def test_frames_stand_alone(tmp_path):
    import zstandard

    system, path = warc.file_system(str(tmp_path))
    bundle = warc.BundleWriter(system, path, "b.warc.zst")
    rows = []
    for i in range(200):
        rows += bundle.add(i, warc.record_bytes(i, None, bytes([i]) * 5000, None, False))
    rows += bundle.close()
    frames = {r[2] for r in rows}
    assert len(rows) == 200 and len(frames) > 2
    with open(tmp_path / "b.warc.zst", "rb") as file:
        whole = zstandard.ZstdDecompressor().stream_reader(file, read_across_frames=True).read()
    assert whole.count(b"WARC-Type: response") == 200


def brute(rows, queries, k):
    out = {}
    for q, qv in queries:
        scored = []
        for i, v in rows:
            if i != q:
                a, b = np.array(v, float), np.array(qv, float)
                scored.append((-((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), i))
        out[q] = [i for _, i in sorted(scored)[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    good = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(600)]
    good[100] = (100, good[50][1])  # ties
    good[7] = (7, good[50][1])
    odd = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] * 24), (905, [1.0] * 3)]
    odd += [(None, good[3][1]), (906, [float("inf")] * 24), good[7]]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in good + odd], "vec_id long, embedding array<float>, label int, list string")
    got = ann.nearest(table, table.where("vec_id % 50 = 0 or vec_id > 899"), k=5).collect()
    want = brute(good, [g for g in good if g[0] % 50 == 0], 5)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert set(found) == set(want)
    assert np.mean([len(set(found[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    assert found[50][:2] == [7, 100] and found[100][:2] == [7, 50]
    assert ann.nearest(table.limit(0), table, k=5).count() == 0
    few = table.where("vec_id in (1, 2, 50)")
    assert ann.nearest(few, few.where("vec_id = 50"), k=5).count() == 2


def test_an_id_with_many_near_vectors_hides_no_other(spark):
    """One id with 300 vectors near all queries; once another id, once the query's own."""
    rng = np.random.default_rng(2)
    middle = rng.normal(size=16)
    rows = [(1, [float(x) for x in middle + 0.01 * rng.normal(size=16)]) for _ in range(300)]
    rows += [(i, [float(x) for x in middle + 0.3 * rng.normal(size=16)]) for i in range(2, 202)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, rows[0][1]), (2, rows[300][1])], "vec_id long, embedding array<double>")
    # Every list that holds a neighbour of the sample is visited.
    got = ann.nearest(table, queries, k=5, target=1.0).orderBy("query_id", "rank").collect()
    for q, vector in ((1, rows[0][1]), (2, rows[300][1])):
        best = {}
        for i, v in rows:
            a, b = np.array(v), np.array(vector)
            c = float((a * b).sum() / np.sqrt((a * a).sum() * (b * b).sum()))
            best[i] = max(best.get(i, -2), c)
        want = sorted((i for i in best if i != q), key=lambda i: -best[i])[:5]
        assert [r.vec_id for r in got if r.query_id == q] == want


def test_scan_keeps_the_nearest():
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(5000, 64)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    q, r = ann.scan(rows, rows[:40], 5)
    hits = 0
    for i in range(40):
        true = np.argsort(-(rows @ rows[i]))[:5]
        hits += len(set(true) & set(r[q == i]))
    assert hits >= 0.97 * 200 and len(q) < 40 * 200
