"""Blocks of items against blocks of queries.

The one step that built-in operators cannot do well: the scores of many items with many
queries without storing a row of each pair. A block of items (an Arrow batch) meets a
block of queries as matrices (vectors dense, weighted words sparse) and leaves its hits,
or one range or at most k rows per query. The items stay where
they are and are read once. Few queries are sent to every task; a larger table is
stored in parts of bounded size that the tasks read one after the other, so it never
passes through the driver. Which items a query's filters permit is computed by Spark
(``filters.numbered``): items bring the numbers of the filter sets that they meet.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.constants import RANK_DIGITS
from shortlist.functions.bm25 import term_weight
from shortlist.operators.queries import MAX_SENT_QUERIES, QueryTable
from shortlist.operators.single import SIGNS, SLACK, Part, in_parts, sides
from shortlist.operators.single import ranges as _ranges
from shortlist.session import MAX_SENT_BYTES, shared_folder

ITEM_COLUMNS = ("id", "embedding", "allowed")
QUERY_COLUMNS = ("query_id", "vector", "filter_no")
# Items with the counts of their words, queries with the idf of theirs.
ITEM_WORDS = ("id", "allowed", "words", "tfs", "length", "avg_length")
QUERY_WORDS = ("query_id", "filter_no", "words", "idfs", "n_terms")
ITEMS_PER_CELL = 50_000
# Items with their words are larger.
ITEMS_WITH_WORDS = 20_000
QUERIES_PER_CELL = 2_048
# Queries without filters have this number.
NO_FILTER = -1
_SCORES_AT_ONCE = 4_000_000
_WORD_SCORES_AT_ONCE = 1_000_000
_ROWS_PENDING = 500_000
# Blocks of fewer items are summed at once; a word in this part of a block counts as frequent.
_FEW_ITEMS = 1_000
_FREQUENT = 4
_SLACK = 2 * 10.0**-RANK_DIGITS
# A query with more pairs than this in a block is summed with all its items.
_MANY_PAIRS = 32
_PAIRS_AT_ONCE = 20_000
# Postings of the parts that a block keeps, as a multiple of its own.
_KEPT_PARTS = 2


@dataclass(frozen=True)
class Scoring:
    """score = weight * cosine.

    ``vectors_only`` leaves out items and queries without a vector; otherwise a
    missing cosine counts as 0.
    """

    k: int
    weight: float = 1.0
    vectors_only: bool = True


@dataclass(frozen=True)
class QueryBlock:
    """Queries of one block: ids, unit vectors, rows by distinct filter set, all columns."""

    ids: np.ndarray
    vectors: np.ndarray | None
    has_vector: np.ndarray
    by_filter: list[tuple[int, np.ndarray]]
    table: pa.Table

    @staticmethod
    def of(table: pa.Table) -> QueryBlock:
        none = None, np.zeros(table.num_rows, dtype=bool)
        vectors, present = unit_rows(table["vector"]) if "vector" in table.column_names else none
        numbers = pc.fill_null(_whole(table["filter_no"]), NO_FILTER).to_numpy(zero_copy_only=False)
        by_filter = [(int(f), np.flatnonzero(numbers == f)) for f in np.unique(numbers)]
        return QueryBlock(table["query_id"].to_pandas().to_numpy(), vectors, present, by_filter, table)

    def numbers(self, name: str, none: float = 0.0) -> np.ndarray:
        """A numeric column; ``none`` where it is NULL or the column is missing."""
        if name not in self.table.column_names:
            return np.full(len(self.ids), none)
        return pc.fill_null(_whole(self.table[name]), none).to_numpy(zero_copy_only=False)


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def unit_rows(column, dims: int | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """Unit vectors of a list column as a matrix, and where there is one.

    Vectors of another length than ``dims`` (by default the most frequent), empty ones
    and those with a null or non-finite component count as missing.
    """
    column = _whole(column)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if dims is None and sizes.any():
        dims = int(np.bincount(sizes[sizes > 0]).argmax())
    given = (sizes == dims) & (sizes > 0)
    if not given.any():
        return None, given
    flat = pc.list_flatten(column.filter(pa.array(given))).to_numpy(zero_copy_only=False)
    some = flat.astype(np.float64).reshape(int(given.sum()), dims)
    finite = np.isfinite(some).all(axis=1)
    some = np.where(finite[:, None], some, 0.0)
    length = np.linalg.norm(some, axis=1)
    matrix = np.zeros((len(column), dims))
    matrix[given] = some / np.where(length > 0, length, 1.0)[:, None]
    present = given.copy()
    present[given] = length > 0
    return matrix, present


def best_rows(rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows per query by rounded score, then id."""
    ordered = rows.assign(_key=-np.round(rows["score"].astype(float), RANK_DIGITS)).sort_values(
        ["query_id", "_key", "id"], kind="stable"
    )
    return ordered[ordered.groupby("query_id").cumcount() < k].drop(columns="_key")


def _members(items: pa.Table, queries: QueryBlock, present: np.ndarray, how: Scoring, most: int = _SCORES_AT_ONCE):
    """Rows of queries with the same filter set, a few at a time, and their items."""
    step = max(1, most // max(1, items.num_rows))
    allowed = _whole(items["allowed"])
    numbers, owner = pc.list_flatten(allowed).to_numpy(zero_copy_only=False), pc.list_parent_indices(allowed).to_numpy()
    for number, members in queries.by_filter:
        keep = np.ones(items.num_rows, dtype=bool)
        if number != NO_FILTER:
            keep[:] = False
            keep[owner[numbers == number]] = True
        if how.vectors_only:
            keep, members = keep & present, members[queries.has_vector[members]]
        at = np.flatnonzero(keep)
        for first in range(0, len(members) if len(at) else 0, step):
            yield members[first : first + step], at


def score_block(items: pa.Table, queries: QueryBlock, how: Scoring) -> pd.DataFrame:
    """Best rows of one block: query_id, id, cosine, score."""
    ids = _whole(items["id"]).to_pandas().to_numpy()
    dims = None if queries.vectors is None else queries.vectors.shape[1]
    matrix, present = unit_rows(items["embedding"], dims)
    # Places in the order of ids, whatever their type.
    by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    found = []
    for rows, at in _members(items, queries, present, how):
        cosine = np.zeros((len(rows), len(at)))
        if matrix is not None and queries.vectors is not None:
            cosine = queries.vectors[rows] @ matrix[at].T
        score = how.weight * cosine
        q, i = _candidates(score, by_id[at], how.k)
        columns = {"query_id": queries.ids[rows[q]], "id": ids[at[i]], "cosine": cosine[q, i], "score": score[q, i]}
        found.append(pd.DataFrame(columns))
    if not found:
        return pd.DataFrame(columns=["query_id", "id", "cosine", "score"])
    return best_rows(pd.concat(found, ignore_index=True), how.k)


def _candidates(score: np.ndarray, by_id: np.ndarray, k: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k best of each row, in the order of rankings; ties by lower id.

    What lies below the ``bound`` of its row is left out.
    """
    n, reach = score.shape[1], np.isfinite(score)
    if bound is not None:
        reach &= score >= bound[:, None] - _SLACK
    # Only rows that are still too long are partitioned.
    many = np.count_nonzero(reach, axis=1) > k
    if n > k and many.any():
        long = score if many.all() else score[many]
        least = np.partition(long, n - k, axis=1)[:, n - k]
        reach[many] &= long >= least[:, None] - _SLACK
    q, i = np.nonzero(reach)
    order = np.lexsort((by_id[i], -np.round(score[q, i], RANK_DIGITS), q))
    q, i = q[order], i[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], i[place < k]


def _alike(codes: np.ndarray, owner: np.ndarray, n: int, known: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of items that puts those with like frequent words together, and where it can be cut."""
    top = np.argsort(-np.bincount(codes, minlength=known), kind="stable")[:SIGNS]
    if n < _FEW_ITEMS or len(top) < 3:
        return np.arange(n), np.array([0, n])
    place = np.full(known, -1)
    place[top] = np.arange(len(top))
    met = place[codes] >= 0
    have = np.zeros((n, len(top)))
    have[owner[met], place[codes[met]]] = 1.0
    side = sides(have)
    return np.argsort(side, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(side, minlength=8))])


class ItemBlock:
    """Items of one block, prepared once for all blocks of queries that they meet."""

    def __init__(self, table: pa.Table):
        words = _whole(table["words"])
        coded = pc.list_flatten(words).dictionary_encode()
        self.known = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False)
        owner = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        tfs = pc.list_flatten(_whole(table["tfs"])).to_numpy(zero_copy_only=False)
        order, self.cuts = _alike(codes, owner, table.num_rows, len(self.known))
        # Items with like words come to lie side by side.
        sizes = np.bincount(owner, minlength=table.num_rows)
        flat = _ranges((np.cumsum(sizes) - sizes)[order], sizes[order])
        codes, tfs, owner = codes[flat], tfs[flat], np.repeat(np.arange(len(order)), sizes[order])
        self.table = table.drop_columns(["words", "tfs"]).take(pa.array(order))
        self.ids = _whole(self.table["id"]).to_pandas().to_numpy()
        self._vectors: dict[int | None, tuple[np.ndarray | None, np.ndarray]] = {}
        length, average = (_whole(self.table[c]).to_numpy(zero_copy_only=False)[owner] for c in ("length", "avg_length"))
        weight = term_weight(tfs, length, average)
        # The items and weights of a word lie side by side.
        order = np.argsort(codes, kind="stable")
        self.code, self.item, self.weight = codes[order].astype(np.int64), owner[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(self.known)))])
        self._dense: dict[int, np.ndarray] = {}
        self._key: np.ndarray | None = None
        self._numbers: tuple[np.ndarray, np.ndarray] | None = None
        self._parts: dict[tuple, Part] = {}

    @property
    def num_rows(self) -> int:
        return self.table.num_rows

    def vectors(self, dims: int | None) -> tuple[np.ndarray | None, np.ndarray]:
        """``unit_rows`` of the vectors."""
        if dims not in self._vectors:
            self._vectors = {dims: unit_rows(self.table["embedding"], dims)}
        return self._vectors[dims]

    def places(self, words: pa.Array) -> np.ndarray:
        """The numbers of distinct words in the block, -1 for others; the fewer words are hashed."""
        met = pc.index_in(self.known, value_set=words)
        place = np.full(len(words), -1)
        place[pc.drop_null(met).to_numpy(zero_copy_only=False)] = np.flatnonzero(pc.is_valid(met).to_numpy(zero_copy_only=False))
        return place

    def weights(self, code: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The weights of words in items, 0 where an item has not the word."""
        if self._key is None:
            self._key = self.code * self.num_rows + self.item
        if not len(self._key):
            return np.zeros(len(code))
        wanted = code * self.num_rows + item
        place = np.minimum(np.searchsorted(self._key, wanted), len(self._key) - 1)
        return np.where(self._key[place] == wanted, self.weight[place], 0.0)

    @staticmethod
    def free(number: int | None) -> bool:
        """Whether this is the number of no filter set."""
        return number is None or number == NO_FILTER

    def permitted(self, number: int | None, some: np.ndarray | None = None) -> np.ndarray:
        """Places of the items that a filter set permits, of all or some items."""
        keep = np.ones(self.num_rows, dtype=bool)
        if not self.free(number):
            if self._numbers is None:
                allowed = _whole(self.table["allowed"])
                flat = pc.list_flatten(allowed).to_numpy(zero_copy_only=False)
                self._numbers = flat, pc.list_parent_indices(allowed).to_numpy()
            numbers, owner = self._numbers
            keep[:] = False
            keep[owner[numbers == number]] = True
        return np.flatnonzero(keep if some is None else keep & some)

    def part(self, key: tuple, at: Callable[[], np.ndarray], matrix: np.ndarray | None) -> Part:
        """Some items in single precision; the last few parts are kept."""
        if key not in self._parts:
            self._parts[key] = Part(self, at(), matrix)
            while len(self._parts) > 1 and sum(len(p.item) for p in self._parts.values()) > _KEPT_PARTS * len(self.item):
                self._parts.pop(next(iter(self._parts)))
        return self._parts[key]

    def dense(self, code: int) -> np.ndarray:
        """The weights of a frequent word in all items."""
        if code not in self._dense:
            row, here = np.zeros(self.num_rows), slice(self.starts[code], self.starts[code + 1])
            row[self.item[here]] = self.weight[here]
            self._dense[code] = row
        return self._dense[code]


class WordScores:
    """Sums of products of the weights of items and the idfs of queries, by common words."""

    def __init__(self, items: ItemBlock, queries: QueryBlock):
        asked = _whole(queries.table["words"])
        self._block, starts = items, items.starts
        # Each word of the queries is looked up once.
        coded = pc.list_flatten(asked).dictionary_encode()
        place = items.places(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        met = place >= 0
        code = place[met]
        owner = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False)[met]
        self._idf = pc.list_flatten(_whole(queries.table["idfs"])).to_numpy(zero_copy_only=False)[met]
        self._code, self._first, self._count = code, starts[code], starts[code + 1] - starts[code]
        self._bounds = np.searchsorted(owner, np.arange(len(queries.ids) + 1))
        self._items = items.num_rows

    def of(self, rows: np.ndarray, at: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Sums of some queries with some items, and if asked the numbers of common words.

        Products are added in the order of the query's words, so equal items have equal sums.
        """
        shape = len(rows), self._items
        common = None
        if counted or self._items < _FEW_ITEMS:
            sums, common = self._at_once(rows, shape, counted)
        else:
            sums, held = np.zeros(shape), np.empty(self._items)
            for line, query in zip(sums, rows, strict=True):
                for n in range(self._bounds[query], self._bounds[query + 1]):
                    self._add(line, n, held)
        if len(at) == self._items:
            return sums, common
        return sums[:, at], None if common is None else common[:, at]

    def asked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of some queries that the block knows: the place in ``rows``, the number, the idf."""
        sizes = self._bounds[rows + 1] - self._bounds[rows]
        here = _ranges(self._bounds[rows], sizes)
        return np.repeat(np.arange(len(rows)), sizes), self._code[here], self._idf[here]

    def pairs(self, rows: np.ndarray, q: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Sums of pairs of queries (``rows[q]``) and items, bitwise those of ``of``; ``q`` ascends."""
        raw, number = np.empty(len(q)), np.bincount(q, minlength=len(rows))
        every = np.arange(self._items)
        for line in np.flatnonzero(number > _MANY_PAIRS):
            here = q == line
            raw[here] = self.of(rows[line : line + 1], every)[0][0][item[here]]
        rest = np.flatnonzero(number[q] <= _MANY_PAIRS)
        for first in range(0, len(rest), _PAIRS_AT_ONCE):
            here = rest[first : first + _PAIRS_AT_ONCE]
            line, code, idf = self.asked(rows[q[here]])
            raw[here] = np.bincount(line, idf * self._block.weights(code, item[here][line]), len(here))
        return raw

    def _add(self, line: np.ndarray, n: int, held: np.ndarray) -> None:
        """Add the products of one word: to all items if it is frequent, else to those that have it."""
        if self._count[n] * _FREQUENT >= self._items:
            np.multiply(self._block.dense(self._code[n]), self._idf[n], out=held)
            line += held
        else:
            here = slice(self._first[n], self._first[n] + self._count[n])
            line[self._block.item[here]] += self._idf[n] * self._block.weight[here]

    def _at_once(self, rows: np.ndarray, shape: tuple[int, int], counted: bool) -> tuple[np.ndarray, np.ndarray | None]:
        sizes = self._bounds[rows + 1] - self._bounds[rows]
        asked = _ranges(self._bounds[rows], sizes)
        count = self._count[asked]
        each = _ranges(self._first[asked], count)
        cell = np.repeat(np.repeat(np.arange(len(rows)) * self._items, sizes), count) + self._block.item[each]
        product = np.repeat(self._idf[asked], count) * self._block.weight[each]
        sums = np.bincount(cell, product, shape[0] * shape[1]).reshape(shape)
        return sums, np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape) if counted else None


_EVERY = Scoring(k=0, vectors_only=False)


def word_hits(items: ItemBlock, queries: QueryBlock, require_all: bool = False) -> Iterator[pd.DataFrame]:
    """query_id, id, raw of the permitted items that share a word (or all) with a query."""
    ids, words, wanted = items.ids, WordScores(items, queries), queries.numbers("n_terms")
    present = np.ones(items.num_rows, dtype=bool)
    for rows, at in _members(items.table, queries, present, _EVERY, _WORD_SCORES_AT_ONCE):
        raw, common = words.of(rows, at, require_all)
        q, i = np.nonzero((common == wanted[rows, None]) & (common > 0) if require_all else raw)
        yield pd.DataFrame({"query_id": queries.ids[rows[q]], "id": ids[at[i]], "raw": raw[q, i]})


def word_ranges(items: ItemBlock, queries: QueryBlock) -> Iterator[pd.DataFrame]:
    """query_id, high, least, missed of the hits of each query in one block.

    ``missed`` is 1 if a permitted item is no hit; ``least`` matters only while it is 0.
    Queries may bring the same of other items: then only blocks that change it leave a row.
    Sums in single precision tell which items can be the highest or lowest.
    """
    words, every = WordScores(items, queries), np.arange(len(queries.ids))
    known = queries.numbers("high"), queries.numbers("least", np.inf), queries.numbers("missed")
    for rows, part, keep in in_parts(items, queries, words, every, None):
        above, below, settled = (x[rows] for x in known)
        near = part.sums(words, rows, np.ones(len(rows)))
        if keep is None:
            top, low = near.max(axis=1), near.min(axis=1)
        else:
            # Sums are not negative, so -1 is never the highest.
            low = np.where(keep, near, np.float32(np.inf)).min(axis=1)
            near[~keep] = -1.0
            top = near.max(axis=1)
        missed = low <= 0
        # Without a miss, the lowest sum is that of a hit.
        wanted = (settled == 0) & ~missed & (low * (1 - SLACK) < below)
        high, least = np.zeros(len(rows)), np.where(missed, 0.0, np.inf)
        raises = (top > 0) & (top * (1 + SLACK) >= above)
        for lines, end, ends, limit, best in (
            (np.flatnonzero(raises), high, top * (1 - SLACK), np.greater_equal, np.maximum),
            (np.flatnonzero(wanted), least, low * (1 + SLACK), np.less_equal, np.minimum),
        ):
            here = near[lines]
            q, i = np.nonzero(limit(here, ends[lines, None].astype(np.float32)) & (here >= 0))
            best.at(end, lines[q], words.pairs(rows[lines], q, part.at[i]))
        # Without a permitted item there is no lowest sum.
        news = np.isfinite(low) & ((high > above) | ((settled == 0) & (missed | (least < below))))
        # What cannot matter is left out of the range.
        frame = {"query_id": queries.ids[rows], "high": high, "least": least, "missed": missed.astype(float)}
        yield pd.DataFrame(frame)[news]


def _scaled(raw: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Keyword scores of some queries on the scale of each; without a span all hits have 1."""
    wide = np.where(span > 0, span, 1.0)[:, None]
    if low.any():
        return np.where(raw > 0, np.where(span[:, None] > 0, (raw - low[:, None]) / wide, 1.0), 0.0)
    # Sums of 0 stay 0.
    return raw / wide


def best_hits_block(items: ItemBlock, queries: QueryBlock, k: int) -> Iterator[pd.DataFrame]:
    """query_id, id, value: the k best hits of each query in one block by scaled keyword score.

    Queries bring ``low`` and ``span``, as for ``fused_block``.
    """
    ids, words, low, span = items.ids, WordScores(items, queries), queries.numbers("low"), queries.numbers("span")
    by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    present = np.ones(items.num_rows, dtype=bool)
    for rows, at in _members(items.table, queries, present, _EVERY, _WORD_SCORES_AT_ONCE):
        raw, _ = words.of(rows, at)
        value = _scaled(raw, low[rows], span[rows])
        q, i = _candidates(np.where(raw > 0, value, -np.inf), by_id[at], k)
        yield pd.DataFrame({"query_id": queries.ids[rows[q]], "id": ids[at[i]], "value": value[q, i]})


def fused_block(items: ItemBlock, queries: QueryBlock, how: Scoring) -> Iterator[pd.DataFrame]:
    """query_id, id, value, score: the k best of each query in one block.

    Queries bring ``low`` and ``span`` of their keyword scores; without a span all hits have 1.
    They may bring a ``bound`` that k items reach: what lies below it does not leave. Sums in
    single precision tell which items can be among the k best; a bound that no keyword score
    reaches alone needs only items with a vector.
    """
    ids = items.ids
    matrix, present = items.vectors(None if queries.vectors is None else queries.vectors.shape[1])
    by_id = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    words, low, span = WordScores(items, queries), queries.numbers("low"), queries.numbers("span")
    bound = queries.numbers("bound", -np.inf)
    plain = ~(span > 0) | (not 0 <= how.weight <= 1)
    alone = bound - SLACK <= how.weight
    both = matrix is not None and queries.vectors is not None
    for group, some in ((~plain & alone, None), (~plain & ~alone, present)):
        for rows, part, keep in in_parts(items, queries, words, np.flatnonzero(group), matrix if both else None, some):
            scale = how.weight / span[rows]
            near = part.sums(words, rows, scale)
            if both:
                near += ((1.0 - how.weight) * queries.vectors[rows]).astype(np.float32) @ part.vectors
            if keep is not None:
                near[~keep] = -np.inf
            least, n = bound[rows] + scale * low[rows], near.shape[1]
            if n > how.k:
                unbound = np.flatnonzero(~np.isfinite(least))
                least[unbound] = np.partition(near[unbound], n - how.k, axis=1)[:, n - how.k]
            q, i = np.nonzero((near >= (least - SLACK).astype(np.float32)[:, None]) & (near > -np.inf))
            q, i = _likely(near, q, i, how.k)
            at = part.at[i]
            raw = words.pairs(rows, q, at)
            value = np.where(raw > 0, (raw - low[rows[q]]) / span[rows[q]], 0.0)
            score = how.weight * value
            if both:
                score += (1.0 - how.weight) * np.einsum("ij,ij->i", queries.vectors[rows[q]], matrix[at])
            kept = score >= bound[rows[q]] - _SLACK
            q, place, value, score = q[kept], at[kept], value[kept], score[kept]
            order = np.lexsort((by_id[place], -np.round(score, RANK_DIGITS), q))
            order = order[np.arange(len(q)) - np.searchsorted(q[order], q[order]) < how.k]
            yield pd.DataFrame({"query_id": queries.ids[rows[q[order]]], "id": ids[place[order]], "value": value[order], "score": score[order]})
    for rows, at in _members(items.table, queries, present, how, _WORD_SCORES_AT_ONCE):
        rows = rows[plain[rows]]
        if not len(rows):
            continue
        raw, _ = words.of(rows, at)
        value = _scaled(raw, low[rows], span[rows])
        score = how.weight * value
        if both:
            score += (1.0 - how.weight) * (queries.vectors[rows] @ matrix[at].T)
        q, i = _candidates(score, by_id[at], how.k, bound[rows])
        yield pd.DataFrame({"query_id": queries.ids[rows[q]], "id": ids[at[i]], "value": value[q, i], "score": score[q, i]})


def _likely(near: np.ndarray, q: np.ndarray, i: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that can be among the k best of their row by sums in single precision."""
    order = np.lexsort((-near[q, i], q))
    q, i = q[order], i[order]
    first = np.searchsorted(q, q)
    last = np.minimum(first + k, np.searchsorted(q, q, side="right")) - 1
    value = near[q, i]
    kept = value >= value[last] - 2 * SLACK
    return q[kept], i[kept]


Block = Callable[[pa.Table, QueryBlock], pd.DataFrame]


def key_types(items: pa.Table, queries: pa.Table) -> dict[str, pa.DataType]:
    return {"query_id": queries.schema.field("query_id").type, "id": items.schema.field("id").type}


def to_arrow(frame: pd.DataFrame, keys: dict[str, pa.DataType]) -> pa.Table:
    fields = [(c, keys.get(c) or pa.float64()) for c in frame.columns]
    return pa.Table.from_pandas(frame, schema=pa.schema(fields), preserve_index=False)


def _against_sent(items: DataFrame, table: QueryTable, how: Scoring, schema: str) -> DataFrame:
    """Every item partition against the whole (small) query table."""
    sent = items.sparkSession.sparkContext.broadcast(table.rows.select(*QUERY_COLUMNS).toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, pending, size, keys = None, [], 0, {}
        for batch in batches:
            part = pa.Table.from_batches([batch])
            if queries is None:
                queries, keys = QueryBlock.of(sent.value), key_types(part, sent.value)
            pending.append(score_block(part, queries, how))
            size += len(pending[-1])
            if size > _ROWS_PENDING:
                pending = [best_rows(pd.concat(pending, ignore_index=True), how.k)]
                size = 0
        if pending:
            yield from to_arrow(best_rows(pd.concat(pending, ignore_index=True), how.k), keys).to_batches()

    return items.mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of about so many rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def _grouped_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.Table]]:
    """The same for each value of ``_group`` by itself: a partition may hold several."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        for group in pc.unique(batch["_group"]).to_pylist():
            some = held.setdefault(group, [])
            some.append(batch.filter(pc.equal(batch["_group"], group)))
            if sum(b.num_rows for b in some) >= rows:
                yield group, pa.Table.from_batches(held.pop(group))
    for group, some in held.items():
        yield group, pa.Table.from_batches(some)


def _stored_parts(folder: str, group: int = 0, groups: int = 1) -> Iterator[pa.Table]:
    """The parts of a stored query table, one at a time; of several groups those of one."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.path.endswith(".parquet"))
    for file in files[group::groups]:
        with system.open_input_file(file) as source:
            yield pq.ParquetFile(source).read()


def _n_parts(table: QueryTable) -> int:
    """Parts of a large query table; they differ in size, so they are planned half full."""
    return max(1, math.ceil(2 * table.n / MAX_SENT_QUERIES), math.ceil(2 * table.size / MAX_SENT_BYTES))


def _store_parts(spark: SparkSession, rows: DataFrame, table: QueryTable) -> str:
    """Folder of a large query table in parts of bounded size, queries of like filters together."""
    folder = f"{shared_folder(spark).rstrip('/')}/queries-{uuid.uuid4().hex}"
    rows.repartitionByRange(_n_parts(table), "filter_no", "query_id").write.parquet(folder)
    return folder


def _against_stored(items: DataFrame, table: QueryTable, how: Scoring, schema: str) -> DataFrame:
    """Every block of items against a large query table, stored in bounded parts.

    Items are read once and never repeated or shuffled; a task holds one part at a time.
    """
    folder = _store_parts(items.sparkSession, table.rows.select(*QUERY_COLUMNS), table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, ITEMS_PER_CELL):
            for part in _stored_parts(folder):
                if part.num_rows:
                    yield from to_arrow(score_block(block, QueryBlock.of(part), how), key_types(block, part)).to_batches()

    return items.mapInArrow(run, schema)


def in_cells(items: DataFrame, queries: DataFrame, block: Block, schema: str) -> DataFrame:
    """Items against the queries of the same (cell, part); both sides are bounded."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return to_arrow(block(left, QueryBlock.of(right)), key_types(left, right))

    keys = ("cell", "part")
    return items.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, schema)


def _type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def candidates_schema(items: DataFrame, queries: DataFrame) -> str:
    """Schema of the rows that ``score_block`` leaves."""
    return f"query_id {_type_of(queries, 'query_id')}, id {_type_of(items, 'id')}, cosine double, score double"


def each_block(
    items: DataFrame,
    table: QueryTable,
    step: Callable[[ItemBlock, QueryBlock], Iterator[pd.DataFrame]],
    item_columns: tuple[str, ...],
    query_columns: tuple[str, ...],
    made: tuple[str, ...],
) -> DataFrame:
    """What ``step`` makes of every block of items and of queries; ``made`` are its columns.

    Rows leave a task as they are made. Items and queries have words (``lexical.with_words``).
    Items of few partitions are read by several groups of tasks, each with some parts of the queries.
    """
    spark, rows = items.sparkSession, table.rows.select(*query_columns)
    items, groups = items.select(*item_columns), 1
    if not table.small:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        groups = max(1, min(tasks // max(1, items.rdd.getNumPartitions()), _n_parts(table)))
    items = reduce(DataFrame.union, [items.withColumn("_group", F.lit(g)) for g in range(groups)])
    if table.small:
        sent, folder = spark.sparkContext.broadcast(rows.toArrow()), None
    else:
        sent, folder = None, _store_parts(spark, rows, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in _grouped_blocks(batches, ITEMS_WITH_WORDS):
            block = ItemBlock(table)
            for part in _stored_parts(folder, group, groups) if sent is None else [sent.value]:
                if part.num_rows:
                    keys = key_types(table, part)
                    for frame in step(block, QueryBlock.of(part)):
                        yield from to_arrow(frame, {c: keys[c] for c in frame.columns if c in keys}).to_batches()

    kinds = {"query_id": _type_of(rows, "query_id"), "id": _type_of(items, "id")}
    return items.mapInArrow(run, ", ".join(f"{c} {kinds.get(c, 'double')}" for c in made))


def top_k_candidates(items: DataFrame, table: QueryTable, how: Scoring) -> DataFrame:
    """Rows that contain the k best items of every query; the caller ranks them.

    ``items`` and ``table`` come from ``filters.numbered``.
    """
    against = _against_sent if table.small else _against_stored
    return against(items.select(*ITEM_COLUMNS), table, how, candidates_schema(items, table.rows))
