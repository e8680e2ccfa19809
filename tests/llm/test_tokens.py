"""Token files, BPE and packing against the tokenizers library and simple loops."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_cases import ODD
from tokenizers import Tokenizer

from shortlist.llm.bpe import WordBpe
from shortlist.llm.bpe_documents import encode_documents
from shortlist.llm.hilbert import hilbert_keys
from shortlist.llm.library_coder import LibraryCoder
from shortlist.llm.packing import pack_documents, sequence_edges
from shortlist.llm.queries import QUERIES
from shortlist.llm.storage import new_folder
from shortlist.llm.token_files import open_parts, read_documents, write_tokens

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def le(ids):
    return np.array(ids, "<u4").tobytes()


def joined(parts, i=0):
    return [[int(x) for x in f] for flat, n in parts for f in np.split(flat, np.cumsum(n)[:-1])]


ODD_TEXTS = [f"a{chr(c)}b{chr(c)}{chr(c)} 1{chr(c)}'{chr(c)} {chr(c)}" for c in range(1, 0x400)] + [
    t or "" for _, t in ODD
]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_library_coder_is_the_library(path):
    coder = LibraryCoder(path)
    want = [e.ids for e in coder.tokenizer.encode_batch(ODD_TEXTS, add_special_tokens=False)]
    assert joined(coder.encode(ODD_TEXTS)) == want
    coder.store.most = 1  # forgets between runs
    assert joined(coder.encode(ODD_TEXTS)) == want


def test_bpe_equals_the_library():
    bpe, tok = WordBpe(WORD), Tokenizer.from_file(WORD)
    want = [e.ids for e in tok.encode_batch(ODD_TEXTS, add_special_tokens=False)]
    assert joined(bpe.encode(ODD_TEXTS)) == want
    for ids in want[-12:]:
        assert bpe.decode(ids) == tok.decode(ids, skip_special_tokens=False)


def test_bpe_accepts_only_what_exact_merging_gives():
    rng = np.random.default_rng(1)
    bpe = WordBpe(WORD)
    parts = [t for t in bpe.inner if t.isalpha() and len(t) < 5]
    words = ["".join(rng.choice(parts, rng.integers(1, 6))) for _ in range(3000)]
    flat, counts = bpe.encode_words(words)
    want = [bpe.merge_exactly(w) for w in words]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want
    assert any(bpe.propose(w) == m for w, m in zip(words, want))
    assert any(bpe.propose(w) != m for w, m in zip(words, want))


def test_proposals_take_time_in_proportion_to_a_word():
    import time

    bpe, times = WordBpe(WORD), []
    for n in (100_000, 1_000_000):
        start = time.perf_counter()
        ids = bpe.propose("ab" * (n // 2))
        times.append(time.perf_counter() - start)
        assert "".join(bpe.strings[i] for i in ids).removesuffix("</w>") == "ab" * (n // 2)
    assert times[1] < 40 * times[0] and times[1] < 20


def test_bpe_documents(odd, docs_of):
    tok = Tokenizer.from_file(WORD)
    got = sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in encode_documents(odd, WORD).collect())
    want = []
    for i, text in ODD:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        want.append((str(i), len(ids), le(ids), tok.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert encode_documents(docs_of([]), WORD).count() == 0


def test_token_files(spark, odd, docs_of):
    tok = Tokenizer.from_file(BYTE)
    folder = new_folder(spark, "t")
    rows = read_documents(write_tokens(odd, folder, BYTE, 0), folder).collect()
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for i, text in ordered:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(le(ids))))
        at += len(ids)
    loose = lambda rs: sorted((str(a), c, d) for a, _, c, d in rs)
    assert loose(rows) == loose(want)
    # Equal ids may follow each other in either order; all starts are right for the rest.
    assert {r[1] for r in rows} >= {w[1] for w in want if w[0] != 8}
    assert sorted(r[1] + r[2] for r in rows)[-1] == at
    assert open_parts(spark, folder).count() >= 1
    empty = new_folder(spark, "t")
    assert read_documents(write_tokens(docs_of([]), empty, BYTE, 0), empty).count() == 0


def test_token_files_of_the_table(spark):
    tok = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op3_token_files"](spark, SF).collect()}
    at = 0
    for d in docs:
        ids = tok.encode(d.text or "", add_special_tokens=False).ids + [0]
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(le(ids)))
        at += len(ids)
    assert len(got) == len(docs)


def test_bpe_query(spark):
    tok = Tokenizer.from_file(WORD)
    got = {r.doc_id: r for r in QUERIES["op4_bpe"](spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = tok.encode(d.text or "", add_special_tokens=False).ids
        r = got.pop(d.doc_id)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(le(ids)).hexdigest())
        text = tok.decode(ids, skip_special_tokens=False)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not got


def test_hilbert_keys_visit_neighbours():
    side = np.arange(16)
    grid = np.stack(np.meshgrid(side, side, side), -1).reshape(-1, 3)
    keys = hilbert_keys(grid, 4)
    path = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(16**3))
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def check_packing(rows, texts):
    """Each id in one piece; sequences gapless, full or a power of two."""
    tok = Tokenizer.from_file(WORD)
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_row[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at == 4096 or (at < 4096 and at & (at - 1) == 0)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, all_texts in texts.items():
        want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [2] for t in all_texts)
        pieces = by_row.pop(doc_id)
        assert sum(p.length for p in pieces) == sum(map(len, want))
        assert {p.doc_tokens for p in pieces} == set(map(len, want))
        if len(want) == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p.start):
                ids = want[0][p.start : p.start + p.length]
                assert p.start == at and p.ids_crc32 == zlib.crc32(le(ids))
                at += p.length
    assert not by_row


def test_packing(odd, docs_of):
    texts = defaultdict(list)
    for i, t in ODD:
        texts[i].append(t)
    check_packing(pack_documents(odd, WORD, 2).collect(), texts)
    assert pack_documents(docs_of([]), WORD, 2).count() == 0


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = QUERIES["op10_packing"](spark, SF).collect()
    check_packing(rows, {d.doc_id: [d.text] for d in docs})


def test_packing_puts_like_documents_side_by_side(docs_of):
    rows = [(i, ("apple pear plum " if i % 2 else "engine wheel brake ") * 400) for i in range(40)]
    got = pack_documents(docs_of(rows), WORD, 2).orderBy("sequence_id", "offset").collect()
    kinds = [r.doc_id % 2 for r in got]
    assert sum(a != b for a, b in zip(kinds, kinds[1:])) == 1


def test_sequence_edges():
    assert sequence_edges(0) == (0, [])
    assert sequence_edges(4096) == (4096, [])
    assert sequence_edges(4096 + 5) == (4096, [4096, 4100])
