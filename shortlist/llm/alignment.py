"""Alignment of the tokens that two tokenizers make of the same bytes.

Places where tokens of both sides end cut a document into groups; tokens whose bytes
overlap are linked. Documents up to ``CHUNK_BYTES`` are aligned where they are encoded,
many at once on arrays. The tokens of longer ones are cut into byte ranges, one row
each, that other tasks turn into fragments: an open head (tokens up to the first common
end), closed groups, an open tail (tokens after the last one). Two neighbouring
fragments compose to one, the tail of the first and the head of the second closing to a
group; composing is associative, so a tree of Spark stages reduces ``FAN`` neighbours at
a time until one fragment of each document is left.

How often an id pair is linked is counted over all documents. Of N links, at most
``SENT_PAIRS`` pairs can have N / ``SENT_PAIRS`` or more; those are sent to every task.
The others, none of them frequent, are joined, so no key of that join is hot.

Nulls: texts that are null or empty, or whose tokens do not give back their bytes, have
no tokens: zeros and empty groups. A null ``doc_id`` stays null; rows that repeat a
document are aligned, and count, each. Ties for the best count are all best. An empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.bpe import byte_chars
from shortlist.llm.library_coder import LibraryCoder
from shortlist.llm.pretokens import PieceStore, per_text, slices
from shortlist.llm.quality import store

CHUNK_BYTES = 1 << 16
FAN = 8
SENT_PAIRS = 1 << 20
_CHARS = 1 << 19
# Distinct pieces that a task keeps for each side; beyond that it forgets and starts anew.
KEPT_PIECES = 1 << 17
ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, "
    "pairs array<long>, times array<int>"
)
CHUNKS = "chunk int, chunks int, ids_a array<int>, ids_b array<int>, start_a long, start_b long"
FRAGMENTS = (
    "row long, doc_id long, chunk int, chunks int, n_a long, n_b long, closed boolean, head_a array<int>, head_b array<int>, "
    "tail_a array<int>, tail_b array<int>, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"
)


class PieceCoder:
    """Ids of whole texts by the sentencepiece library, distinct units encoded once a task.

    Where no piece holds a space but at its start, or a line break, and texts are not
    normalized, merges never cross into a unit: some spaces or one line break, and what
    follows up to the next. Other models get whole texts.
    """

    def __init__(self, path: str):
        import re

        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(self.size)]
        free = all("▁" not in p.lstrip("▁") and " " not in p and "\n" not in p for p in pieces)
        by_byte = all(self.model.is_byte(self.model.piece_to_id(f"<0x{b:02X}>")) for b in range(256))
        as_given = b"\x0a\x08identity" in self.model.serialized_model_proto()
        starts = self.model.encode("a\n")[:1] == self.model.encode("a") and self.model.encode("\n")[:1] == [self.model.piece_to_id("▁")]
        self.unit = re.compile("(?: +|\n)[^ \n]*") if free and by_byte and as_given and starts else None
        self.store = PieceStore(self._encode, KEPT_PIECES)

    def token_bytes(self) -> list[bytes]:
        """The bytes of each id; of control pieces their names."""
        out = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())
        return out

    def _flat(self, found):
        import numpy as np

        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(counts.sum())), counts

    def _encode(self, units: list[str]):
        # The model puts a space in front of what it is given.
        given = [u if u[0] == "\n" else u[1:] for u in units]
        found = self.model.encode(given, num_threads=1)
        space = self.model.piece_to_id("▁")
        return self._flat([ids[1:] if u[0] == "\n" else ids or [space] for u, ids in zip(units, found)])

    def encode(self, texts: list[str]):
        """(flat ids, ids per text) of texts that are not empty."""
        import numpy as np

        if self.unit is None:
            return self._flat(self.model.encode(texts, num_threads=1))
        units, sizes = [], []
        for text in texts:
            got = self.unit.findall(" " + text)
            units += got
            sizes.append(len(got))
        flat, counts = self.store.lookup(units)
        return flat, per_text(counts, np.array(sizes, np.int64))


class ByteCoder:
    """Ids of whole texts by the tokenizers library; special tokens are plain text."""

    def __init__(self, path: str):
        self.coder = LibraryCoder(path)
        self.coder.tokenizer.encode_special_tokens = True
        self.coder.store.most = KEPT_PIECES
        self.size = self.coder.size

    def token_bytes(self) -> list[bytes]:
        back = {c: b for b, c in byte_chars().items()}
        out = [b""] * self.size
        for token, i in self.coder.tokenizer.get_vocab(with_added_tokens=True).items():
            out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        return out

    def encode(self, texts: list[str]):
        """(flat ids, ids per text), with a space in front of each text."""
        import numpy as np

        parts = list(self.coder.encode([" " + t for t in texts]))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


@dataclass(frozen=True)
class Sizes:
    """Bytes of each token of both sides."""

    a: object
    b: object

    @staticmethod
    def of(path_a: str, path_b: str) -> Sizes:
        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        lists = ByteCoder(path_a).token_bytes(), PieceCoder(path_b).token_bytes()
        return Sizes(*(np.array(list(map(len, x)), np.int64) for x in lists))


class Joint:
    """Two runs of tokens over the same bytes, which begin and end together.

    ``last_a`` and ``last_b`` mark the tokens that end a group. Between two ends there
    is one token of each side, so each stretch between neighbouring ends is one link:
    ``pairs``, ending at ``link_ends``.
    """

    def __init__(self, ids_a, ids_b, sizes: Sizes):
        import numpy as np

        self.ids_a, self.ids_b = ids_a.astype(np.int64), ids_b.astype(np.int64)
        self.ends_a, ends_b = np.cumsum(sizes.a[self.ids_a]), np.cumsum(sizes.b[self.ids_b])
        # Marks of the places where tokens end, by byte.
        marks = np.zeros((2, int(self.ends_a[-1]) + 1), bool)
        marks[0, self.ends_a] = marks[1, ends_b] = True
        self.last_a, self.last_b = marks[1, self.ends_a], marks[0, ends_b]
        self.link_ends = np.flatnonzero(marks[0] | marks[1])
        token_a, token_b = (np.cumsum(m[self.link_ends]) - m[self.link_ends] for m in marks)
        self.pairs = self.ids_a[token_a] * len(sizes.b) + self.ids_b[token_b]

    def text(self):
        """(bytes of ``a,a|b;`` for all groups, where the text of each group ends)."""
        import numpy as np

        group_a, group_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        n = int(self.last_a.sum())
        per_a, per_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
        spot_a = np.arange(len(group_a)) + (np.cumsum(per_b) - per_b)[group_a]
        spot_b = np.arange(len(group_b)) + np.cumsum(per_a)[group_b]
        ids, mark = np.empty(len(spot_a) + len(spot_b), np.int64), np.empty(len(spot_a) + len(spot_b), np.uint8)
        ids[spot_a], ids[spot_b] = self.ids_a, self.ids_b
        mark[spot_a] = np.where(self.last_a, ord("|"), ord(","))
        mark[spot_b] = np.where(self.last_b, ord(";"), ord(","))
        digits, width = _digits(int(ids.max(initial=0)) + 1)
        used = width[ids]
        ends = np.cumsum(used + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        begin = ends - used - 1
        out[ends - 1] = mark
        for d in range(digits.shape[1]):
            some = np.flatnonzero(used > d)
            out[begin[some] + d] = digits[ids[some], d]
        return out, ends[spot_b[self.last_b]]


_DIGITS: dict = {}


def _digits(n: int):
    """Decimal digits of 0 .. n - 1 as a matrix, and their number."""
    import numpy as np

    key = 1 << n.bit_length()
    if key not in _DIGITS:
        texts = np.arange(key).astype("S")
        matrix = texts.view(np.uint8).reshape(key, -1)
        _DIGITS[key] = matrix, (matrix != 0).sum(1)
    return _DIGITS[key]


def counted(pairs):
    """(distinct values in order, how often each occurs)."""
    import numpy as np

    pairs = np.sort(pairs)
    first = np.flatnonzero(np.concatenate([pairs[:1] == pairs[:1], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.diff(np.concatenate([first, [len(pairs)]]))


def _lists(values, counts, kind):
    import numpy as np
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


def _no_lists(n: int, kind):
    import numpy as np

    return _lists(np.zeros(0), np.zeros(n, np.int64), kind)


def _batch(schema: str, columns: dict):
    """A record batch of the given columns; the others are null."""
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [tuple(part.split()) for part in schema.split(", ")]
    n = len(next(iter(columns.values())))
    arrays = []
    for name, kind in fields:
        value = columns.get(name)
        if value is None:
            value = pa.nulls(n, kinds[kind])
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, kinds[kind]))
    return pa.record_batch(arrays, schema=pa.schema([(n, kinds[k]) for n, k in fields]))


class Encoder:
    """Tokens of both sides of the texts of a task, aligned or cut into byte ranges."""

    def __init__(self, path_a: str, path_b: str, sizes: Sizes, chunk_bytes: int):
        self.a, self.b = ByteCoder(path_a), PieceCoder(path_b)
        self.bytes_a, self.bytes_b = self.a.token_bytes(), self.b.token_bytes()
        self.sizes, self.chunk_bytes = sizes, chunk_bytes

    def _tokens(self, texts: list[str]):
        """Both sides' ids and counts, with no tokens where bytes differ, and bytes per text."""
        import numpy as np

        given = [(" " + t).encode() if t else b"" for t in texts]
        some = [i for i, t in enumerate(texts) if t]
        sides, good = [], np.array([bool(t) for t in texts])
        for coder, table in ((self.a, self.bytes_a), (self.b, self.bytes_b)):
            counts = np.zeros(len(texts), np.int64)
            flat = np.zeros(0, np.uint32)
            if some:
                flat, counts[some] = coder.encode([texts[i] for i in some])
            ends, ids = np.cumsum(counts), flat.tolist()
            for i in some:
                good[i] &= b"".join(map(table.__getitem__, ids[ends[i] - counts[i] : ends[i]])) == given[i]
            sides.append((flat, counts))
        out = []
        for flat, counts in sides:
            out += [flat[np.repeat(good, counts)], np.where(good, counts, 0)]
        return *out, np.where(good, list(map(len, given)), 0)

    def run(self, ids, texts: list[str], first_row: int):
        """Record batches of aligned documents and of byte ranges of longer ones."""
        import numpy as np

        flat_a, n_a, flat_b, n_b, n_bytes = self._tokens(texts)
        long = n_bytes > self.chunk_bytes
        rows = first_row + np.arange(len(texts))
        yield self._short(ids, rows, flat_a, n_a, flat_b, n_b, n_bytes, long)
        at_a, at_b = np.cumsum(n_a), np.cumsum(n_b)
        for i in np.flatnonzero(long):
            one = slice(at_a[i] - n_a[i], at_a[i]), slice(at_b[i] - n_b[i], at_b[i])
            yield self._ranges(ids[int(i)], rows[i], flat_a[one[0]], flat_b[one[1]], n_bytes[i])

    def _short(self, ids, rows, flat_a, n_a, flat_b, n_b, n_bytes, long):
        import numpy as np
        import pyarrow as pa

        here = np.flatnonzero(~long)
        flat_a, flat_b = flat_a[np.repeat(~long, n_a)], flat_b[np.repeat(~long, n_b)]
        n_a, n_b, stops = n_a[here], n_b[here], np.cumsum(n_bytes[here])
        texts = [""] * len(here)
        n_groups = n_links = np.zeros(len(here), np.int64)
        lists = {"pairs": _no_lists(len(here), np.int64), "times": _no_lists(len(here), np.int32)}
        if len(flat_a):
            # All texts one after another: each ends where tokens of both sides end.
            joint = Joint(flat_a, flat_b, self.sizes)
            link_owner = np.searchsorted(stops, joint.link_ends)
            n_groups = np.bincount(np.searchsorted(stops, joint.ends_a[joint.last_a]), minlength=len(here))
            n_links = np.bincount(link_owner, minlength=len(here))
            written, group_stops = joint.text()
            edges = np.concatenate([[0], group_stops])[np.concatenate([[0], np.cumsum(n_groups)])]
            raw = written.tobytes().decode("ascii")
            texts = [raw[s : max(s, e - 1)] for s, e in zip(edges[:-1].tolist(), edges[1:].tolist())]
            n_pairs = len(self.sizes.a) * len(self.sizes.b)
            owned, times = counted(link_owner * n_pairs + joint.pairs)
            n, pairs = np.bincount(owned // n_pairs, minlength=len(here)), owned % n_pairs
            lists = {"pairs": _lists(pairs, n, np.int64), "times": _lists(times, n, np.int32)}
        columns = {"row": rows[here], "doc_id": ids.take(pa.array(here)), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": texts}
        return _batch(f"{ALIGNED}, {CHUNKS}", columns | lists)

    def _ranges(self, doc_id, row, ids_a, ids_b, n_bytes):
        import numpy as np

        n = -(-int(n_bytes) // self.chunk_bytes)
        columns = {"row": np.full(n, row), "doc_id": [doc_id.as_py()] * n, "chunk": np.arange(n, dtype=np.int32), "chunks": np.full(n, n, np.int32)}
        for side, flat, sizes in (("a", ids_a, self.sizes.a), ("b", ids_b, self.sizes.b)):
            ends = np.cumsum(sizes[flat])
            # A token belongs to the range in which it ends.
            counts = np.bincount((ends - 1) // self.chunk_bytes, minlength=n)
            columns[f"ids_{side}"] = _lists(flat, counts, np.int32)
            columns[f"start_{side}"] = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
        return _batch(f"{ALIGNED}, {CHUNKS}", columns)


@dataclass
class Fragment:
    """Tokens up to the first common end, closed groups, tokens after the last one.

    Not ``closed``: all tokens are in the head. ``groups`` ends in ``;`` if not empty.
    """

    closed: bool
    head: tuple
    tail: tuple
    n_groups: int
    n_links: int
    groups: str
    pairs: object
    times: object

    @staticmethod
    def empty(closed: bool) -> Fragment:
        import numpy as np

        none = np.zeros(0, np.int64)
        return Fragment(closed, (none, none), (none, none), 0, 0, "", none, none)

    @staticmethod
    def of(ids_a, ids_b, start_a: int, start_b: int, sizes: Sizes) -> Fragment:
        """The fragment of a byte range, from its tokens and where their first ones start."""
        import numpy as np

        ends_a, ends_b = start_a + np.cumsum(sizes.a[ids_a]), start_b + np.cumsum(sizes.b[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        out = Fragment.empty(len(common) > 0)
        if not len(common):
            out.head = ids_a, ids_b
            return out
        cut_a, cut_b = (np.searchsorted(e, common[[0, -1]], side="right") for e in (ends_a, ends_b))
        out.head = ids_a[: cut_a[0]], ids_b[: cut_b[0]]
        out.tail = ids_a[cut_a[1] :], ids_b[cut_b[1] :]
        out._close(ids_a[cut_a[0] : cut_a[1]], ids_b[cut_b[0] : cut_b[1]], sizes)
        return out

    def _close(self, ids_a, ids_b, sizes: Sizes) -> None:
        """Appends the groups of tokens that begin and end together."""
        import numpy as np

        if not len(ids_a):
            return
        joint = Joint(ids_a, ids_b, sizes)
        pairs, times = counted(joint.pairs)
        self.n_groups += int(joint.last_a.sum())
        self.n_links += len(joint.pairs)
        self.groups += joint.text()[0].tobytes().decode("ascii")
        self._add(pairs, times)

    def _add(self, pairs, times) -> None:
        import numpy as np

        self.pairs, place = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        self.times = np.bincount(place, np.concatenate([self.times, times]), len(self.pairs)).astype(np.int64)

    def then(self, other: Fragment, sizes: Sizes) -> Fragment:
        """The fragment of both byte ranges, ``other`` following this one."""
        import numpy as np

        def joined(left, right):
            return tuple(np.concatenate(side) for side in zip(left, right))

        out = Fragment(self.closed or other.closed, self.head, self.tail, self.n_groups, self.n_links, self.groups, self.pairs, self.times)
        if not self.closed:
            out.head = joined(self.head, other.head)
        elif other.closed:
            out._close(*joined(self.tail, other.head), sizes)
        else:
            out.tail = joined(self.tail, other.head)
        if other.closed:
            out.tail = other.tail
            out.n_groups += other.n_groups
            out.n_links += other.n_links
            out.groups += other.groups
            out._add(other.pairs, other.times)
        return out

    def columns(self) -> dict:
        import numpy as np

        def one(values, kind):
            return _lists(np.asarray(values), [len(values)], kind)

        open_parts = {f"{name}_{side}": one(part[k], np.int32) for name, part in (("head", self.head), ("tail", self.tail)) for k, side in enumerate("ab")}
        counts = {"closed": [self.closed], "n_groups": [self.n_groups], "n_links": [self.n_links], "groups": [self.groups]}
        return open_parts | counts | {"pairs": one(self.pairs, np.int64), "times": one(self.times, np.int32)}


def _array(row: dict, name: str):
    import numpy as np

    return np.array(row[name], np.int64)


def _fragment_task(sizes: Sizes):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids_a, ids_b = _array(row, "ids_a"), _array(row, "ids_b")
                made = Fragment.of(ids_a, ids_b, row["start_a"], row["start_b"], sizes)
                key = {c: [row[c]] for c in ("row", "doc_id", "chunk", "chunks")}
                yield _batch(FRAGMENTS, key | {"n_a": [len(ids_a)], "n_b": [len(ids_b)]} | made.columns())

    return run


def _fragment_of(row: dict) -> Fragment:
    head, tail = ((_array(row, f"{part}_a"), _array(row, f"{part}_b")) for part in ("head", "tail"))
    counts = (row[c] for c in ("n_groups", "n_links", "groups"))
    return Fragment(row["closed"], head, tail, *counts, _array(row, "pairs"), _array(row, "times"))


def _compose_task(sizes: Sizes):
    """Up to ``FAN`` neighbouring fragments of a document become one."""

    def run(table):
        import pyarrow as pa

        rows = table.sort_by("chunk").to_pylist()
        whole = reduce(lambda one, other: one.then(other, sizes), map(_fragment_of, rows))
        key = {c: [rows[0][c]] for c in ("row", "doc_id", "chunks")} | {"chunk": [rows[0]["chunk"] // FAN]}
        total = {c: [sum(r[c] for r in rows)] for c in ("n_a", "n_b")}
        return pa.Table.from_batches([_batch(FRAGMENTS, key | total | whole.columns())])

    return run


def _finish_task(sizes: Sizes):
    """Documents of which one fragment is left; their bytes begin at a common end."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                whole = Fragment.empty(True).then(_fragment_of(row), sizes)
                key = {c: [row[c]] for c in ("row", "doc_id", "n_a", "n_b")}
                yield _batch(ALIGNED, key | whole.columns() | {"groups": [whole.groups[:-1]]})

    return run


def reduced(ranges: DataFrame, sizes: Sizes) -> DataFrame:
    """Aligned documents from the byte ranges of their tokens."""
    rows = ranges.repartition("row", "chunk").mapInArrow(_fragment_task(sizes), FRAGMENTS)
    most = ranges.agg(F.max("chunks")).first()[0] or 0
    while most > 1:
        groups = rows.withColumn("_part", F.floor(F.col("chunk") / FAN)).groupBy("row", "_part")
        rows = groups.applyInArrow(_drop_part(_compose_task(sizes)), FRAGMENTS)
        most = -(-most // FAN)
    return rows.mapInArrow(_finish_task(sizes), ALIGNED)


def _drop_part(run):
    return lambda table: run(table.drop_columns("_part"))


def _encode_task(path_a: str, path_b: str, sizes: Sizes, chunk_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        encoder, row = None, TaskContext.get().partitionId() << 40
        for batch in batches:
            encoder = encoder or Encoder(path_a, path_b, sizes, chunk_bytes)
            done = 0
            for texts in slices(batch.column("text").to_pylist(), _CHARS):
                ids = batch.column("doc_id").slice(done, len(texts))
                yield from encoder.run(ids, texts, row)
                done += len(texts)
                row += len(texts)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One stored row per document: counts, groups, and its id pairs with their times.

    ``row`` numbers the rows. ``groups`` has the ids ``a,a|b`` of each group, joined by
    ``;``; without ``with_groups`` it is the sha256 of that text instead (of none: empty).
    A pair is id of A * size of B's vocabulary + id of B.
    """
    sizes = Sizes.of(path_a, path_b)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = texts.mapInArrow(_encode_task(path_a, path_b, sizes, chunk_bytes), f"{ALIGNED}, {CHUNKS}")
    digest = F.when(F.col("groups") != "", F.sha2("groups", 256)).otherwise(F.col("groups"))
    kept = F.col("groups") if with_groups else digest
    rows = store(made.withColumn("groups", kept))
    long = reduced(rows.where("chunk is not null"), sizes).withColumn("groups", kept)
    short = rows.where("chunk is null").select(*long.columns)
    # Documents that were cut are few or none; stored, as later stages read them twice.
    return short.unionByName(store(long))


def _sum_pairs(batches):
    import numpy as np

    for batch in batches:
        pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy()
        if len(pairs):
            distinct, n = counted(np.repeat(pairs, times))
            yield _batch("pair long, n long", {"pair": distinct, "n": n})


def pair_counts(aligned: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): links of each id pair; whether no other pair of its B id has more."""
    sums = aligned.select("pairs", "times").mapInArrow(_sum_pairs, "pair long, n long")
    counts = sums.groupBy("pair").agg(F.sum("n").alias("n"))
    of_b = Window.partitionBy(F.col("pair") % size_b)
    return store(counts.withColumn("best", F.col("n") == F.max("n").over(of_b)))


def _sent_sums(sent):
    """Sums of a document over the pairs that every task has."""

    def run(batches):
        import numpy as np

        for batch in batches:
            owner, times, known, place = _found(batch, sent)
            n = batch.num_rows
            _, count, best = sent.value
            owner, times, place = owner[known], times[known], place[known]
            sums = [np.bincount(owner, times * x[place], n).astype(np.int64) for x in (best, count)]
            columns = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups")}
            yield _batch(_SUMS, columns | {"sent_best": sums[0], "sent_count": sums[1]})

    return run


_SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, sent_best long, sent_count long"


def _found(batch, sent):
    """(row, times, whether sent, place) of every pair of a batch."""
    import numpy as np

    lists = batch.column("pairs")
    pairs, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
    sent_pairs = sent.value[0]
    place = np.minimum(np.searchsorted(sent_pairs, pairs), max(len(sent_pairs) - 1, 0))
    known = sent_pairs[place] == pairs if len(sent_pairs) else np.zeros(len(pairs), bool)
    return owner, times, known, place


def _others(sent):
    """(row, pair, times) of the pairs that were not sent."""

    def run(batches):
        for batch in batches:
            owner, times, known, _ = _found(batch, sent)
            rows = batch.column("row").to_numpy()[owner[~known]]
            pairs = batch.column("pairs").flatten().to_numpy()[~known]
            yield _batch("row long, pair long, times long", {"row": rows, "pair": pairs, "times": times[~known]})

    return run


def with_link_counts(aligned: DataFrame, size_b: int, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """Adds ``n_best`` (links of a best pair) and ``count_sum`` (of the counts of all links)."""
    counts = pair_counts(aligned, size_b)
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") * sent_pairs >= total
    # At most ``sent_pairs`` pairs can be as frequent as that.
    table = counts.where(frequent).orderBy("pair").toArrow()
    columns = table["pair"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy().astype("int64")
    sent = aligned.sparkSession.sparkContext.broadcast(columns)
    rows = aligned.mapInArrow(_sent_sums(sent), _SUMS)
    other = aligned.select("row", "pairs", "times").mapInArrow(_others(sent), "row long, pair long, times long")
    rare = counts.where(~frequent)
    n, best = F.sum(F.col("times") * F.col("n")), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0))
    more = other.join(rare, "pair").groupBy("row").agg(n.alias("more_count"), best.alias("more_best"))
    joined = rows.join(more, "row", "left").na.fill(0, ["more_count", "more_best"])
    return joined.select(
        *(c for c in aligned.columns if c not in ("pairs", "times")),
        (F.col("sent_best") + F.col("more_best")).alias("n_best"),
        (F.col("sent_count") + F.col("more_count")).alias("count_sum"),
    )
