"""Token alignment against loops over tokens, and fragments in any tree."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from llm_cases import ODD
from tokenizers import Tokenizer

from shortlist.llm import alignment
from shortlist.llm.alignment import Fragment, Joint, Sizes
from shortlist.llm.bpe import byte_chars

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello world, it's  a\n\n test 12345 !!",
    None,
    "",
    " ",
    "\n",
    "  two  spaces \n next\n\n  line\t tab ",
    "<|endoftext|> <s> and </s> <0x41>",
    "中文 größer ﬁ é \x00 ​ x　y \U0001f600",
    "holds ▁ a mark",
    "word " * 300 + "a" * 900,
    "The cat\r\nsat. The cat sat. Hello world",
]


@pytest.fixture(scope="module")
def plain():
    """Rows by loops, with the two libraries on whole texts."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: x for x, c in byte_chars().items()}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return None
        given = (" " + text).encode()
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        sides = []
        for ids, by in ((ids_a, lambda i: bytes(back[c] for c in a.id_to_token(i))), (ids_b, bytes_b)):
            parts = [by(i) for i in ids]
            if b"".join(parts) != given:
                return None
            ends = np.cumsum([len(p) for p in parts]).tolist()
            sides.append(list(zip(ids, [0, *ends], ends)))
        return sides

    def rows(texts):
        counts, found = Counter(), []
        for text in texts:
            sides = tokens(text)
            if sides is None:
                found.append(None)
                continue
            left, right = sides
            links = [(x, y) for x, s, e in left for y, t, f in right if max(s, t) < min(e, f)]
            counts.update(links)
            ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
            groups = []
            for low, high in zip([0, *ends], ends):
                groups.append("|".join(",".join(str(i) for i, _, e in side if low < e <= high) for side in sides))
            found.append((len(left), len(right), groups, links))
        best = {}
        for (_, y), n in counts.items():
            best[y] = max(best.get(y, 0), n)
        out = []
        for row in found:
            if row is None:
                out.append((0, 0, 0, 0, 0, 0, ""))
                continue
            n_a, n_b, groups, links = row
            n_best = sum(counts[p] == best[p[1]] for p in links)
            out.append((n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), ";".join(groups)))
        return out

    return rows


def got(docs, chunk_bytes=alignment.CHUNK_BYTES, sent=alignment.SENT_PAIRS, with_groups=True):
    aligned = alignment.align(docs, A, B, with_groups, chunk_bytes)
    rows = alignment.with_link_counts(aligned, len(Sizes.of(A, B).b), sent).collect()
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in rows)


@pytest.mark.parametrize("chunk_bytes, sent", [(alignment.CHUNK_BYTES, alignment.SENT_PAIRS), (40, 20), (3, 1)])
def test_alignment(spark, docs_of, plain, chunk_bytes, sent):
    rows = list(enumerate(TEXTS))
    want = sorted((i, *row) for (i, _), row in zip(rows, plain(TEXTS)))
    assert sum(r[1] > 0 for r in want) >= 6
    have = got(docs_of(rows).repartition(3), chunk_bytes, sent)
    for x, y in zip(have, want):
        assert x == y


def test_digests(spark, docs_of, plain):
    rows = list(enumerate(TEXTS))
    want = [(i, r[-1] and hashlib.sha256(r[-1].encode()).hexdigest()) for i, r in enumerate(plain(TEXTS))]
    for chunk_bytes in (alignment.CHUNK_BYTES, 25):
        assert [(r[0], r[-1]) for r in got(docs_of(rows), chunk_bytes, with_groups=False)] == want


def test_odd_rows(spark, odd, docs_of, plain):
    want = sorted((-1 if i is None else i, *row) for (i, _), row in zip(ODD, plain([t for _, t in ODD])))
    assert got(odd) == want and got(odd, 64) == want
    assert got(docs_of([])) == []


def test_fragments_compose_in_any_tree():
    rng = random.Random(3)
    sizes = Sizes(np.array([1, 2, 3, 4, 5, 6]), np.array([1, 2, 3, 5, 7]))

    def run(side, total):
        out = []
        while total:
            out.append(rng.choice([i for i, n in enumerate(side) if n <= total]))
            total -= side[out[-1]]
        return np.array(out, np.int64)

    for _ in range(200):
        total = rng.randint(1, 60)
        ids_a, ids_b = run(sizes.a, total), run(sizes.b, total)
        ends_a, ends_b = np.cumsum(sizes.a[ids_a]), np.cumsum(sizes.b[ids_b])
        joint = Joint(ids_a, ids_b, sizes)
        cuts = [0, *sorted(rng.sample(range(1, total), min(total - 1, rng.randint(0, 8)))), total]
        parts = []
        for low, high in zip(cuts, cuts[1:]):
            p, q = ((e > low) & (e <= high) for e in (ends_a, ends_b))
            starts = [int((e - s)[m][0]) if m.any() else 0 for e, s, m in ((ends_a, sizes.a[ids_a], p), (ends_b, sizes.b[ids_b], q))]
            parts.append(Fragment.of(ids_a[p], ids_b[q], *starts, sizes))
        left = reduce(lambda x, y: x.then(y, sizes), parts)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].then(parts[k + 1], sizes)]
        for whole in (left, parts[0]):
            whole = Fragment.empty(True).then(whole, sizes)
            assert whole.groups == joint.text()[0].tobytes().decode()
            assert whole.n_groups == joint.last_a.sum() and whole.n_links == len(joint.pairs)
            assert dict(zip(whole.pairs.tolist(), whole.times.tolist())) == Counter(joint.pairs.tolist())
            assert not len(whole.tail[0]) and not len(whole.tail[1])


def test_units_encode_as_whole_texts():
    coder, model = alignment.PieceCoder(B), sentencepiece.SentencePieceProcessor(model_file=B)
    assert coder.unit is not None
    rng = random.Random(8)
    signs = [" ", "  ", "\n", "a", "the", "ing", "é", "中", "\t", "<s>", "\r", "1", ".", " ", "   ", "\n\n"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 30))) for _ in range(400)]
    flat, counts = coder.encode(texts)
    assert flat.tolist() == [i for ids in model.encode(texts) for i in ids]
    assert counts.tolist() == [len(ids) for ids in model.encode(texts)]
