"""Sums in single precision that tell which few pairs of a block need exact scores.

All queries meet all permitted items of a block, but only the items near the top of a query
can be results. Words of many items are columns of a matrix product, the others are added
where they occur. What lies within ``SLACK`` of a bound is then summed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np

if TYPE_CHECKING:
    from shortlist.operators.blocks import ItemBlock, QueryBlock, WordScores

# Far above the error of a sum of some hundred products in single precision.
SLACK = 1e-4
# A word in this part of the items can be a column.
_COLUMNS = 20
# So many products of a column cost as much as one product that is added by its place.
_GAIN = 400
_AT_ONCE = 2_500_000
# Filter sets of fewer queries meet all items, and what they do not permit is left out after.
_FEW_QUERIES = 1_500
# Frequent words by which items and queries with like words are put together.
SIGNS = 64


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of ranges one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def sides(have: np.ndarray) -> np.ndarray:
    """A number from 0 to 7 for each row: on which side of the three widest axes it lies."""
    have = have - have.mean(axis=0)
    _, axes = np.linalg.eigh(have.T @ have)
    side = have @ axes[:, -3:] > 0
    return side @ np.array([1, 2, 4])[-side.shape[1] :]


class Part:
    """Some items of a block; ``at`` are their places in it.

    Items with like words lie side by side in a block (``cuts``), so few words are columns of each run.
    """

    def __init__(self, block: ItemBlock, at: np.ndarray, matrix: np.ndarray | None):
        self.at, item, weight, code = at, block.item, block.weight, block.code
        if len(at) < block.num_rows:
            place = np.full(block.num_rows, -1)
            place[at] = np.arange(len(at))
            item = place[item]
            kept = item >= 0
            item, weight, code = item[kept], weight[kept], code[kept]
        self.item, self.weight = item, weight
        self.cuts = np.searchsorted(at, block.cuts)
        runs, words = len(self.cuts) - 1, len(block.known)
        run = np.repeat(np.arange(runs), np.diff(self.cuts))
        # The postings of a word lie in the order of the items, so those of a run lie side by side.
        size = np.bincount(code * runs + run[item], minlength=words * runs)
        self.first = (np.cumsum(size) - size).reshape(words, runs).T.copy()
        self.size = size.reshape(words, runs).T.copy()
        self.columns = [self._columns(n) for n in range(runs)]
        self.vectors = None if matrix is None else np.ascontiguousarray(matrix[at].T, dtype=np.float32)

    def _columns(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The frequent words of a run of items: their numbers, the place of each word, the weights."""
        n, size = self.cuts[run + 1] - self.cuts[run], self.size[run]
        frequent = np.flatnonzero(size * _COLUMNS >= max(1, n))
        column = np.full(len(size), -1)
        column[frequent] = np.arange(len(frequent))
        rows = np.zeros((len(frequent), n), dtype=np.float32)
        here = ranges(self.first[run, frequent], size[frequent])
        rows[np.repeat(np.arange(len(frequent)), size[frequent]), self.item[here] - self.cuts[run]] = self.weight[here]
        return frequent, column, rows

    def sums(self, words: WordScores, rows: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Sums of the common words of some queries with all items, times the ``scale`` of each query."""
        found = np.empty((len(rows), len(self.at)), dtype=np.float32)
        line, code, factor = words.asked(rows)
        factor = factor * scale[line]
        for run, (start, end) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            if start < end:
                met = self.size[run, code] > 0
                found[:, start:end] = self._run_sums(run, len(rows), line[met], code[met], factor[met])
        return found

    def _run_sums(self, run: int, lines: int, line: np.ndarray, code: np.ndarray, factor: np.ndarray) -> np.ndarray:
        frequent, column, rows = self.columns[run]
        n, size, column = rows.shape[1], self.size[run, code], column[code]
        often = np.bincount(column[column >= 0], minlength=len(frequent))
        taken = (often > 0) & (often * self.size[run, frequent] * _GAIN >= lines * n)
        dense = (column >= 0) & np.append(taken, False)[column]
        wanted = np.zeros((lines, np.count_nonzero(taken)), dtype=np.float32)
        wanted[line[dense], (np.cumsum(taken) - 1)[column[dense]]] = factor[dense]
        found = wanted @ (rows if taken.all() else rows[taken])
        line, code, factor, size = (x[~dense] for x in (line, code, factor, size))
        here = ranges(self.first[run, code], size)
        if len(here):
            cell = np.repeat(line * n - self.cuts[run], size) + self.item[here]
            product = np.repeat(factor, size) * self.weight[here]
            found += np.bincount(cell, product, lines * n).reshape(lines, n)
        return found

    def alike(self, words: WordScores, rows: np.ndarray) -> np.ndarray:
        """The queries in an order that puts those with like frequent words together."""
        number = self.size.sum(axis=0)
        top = np.argsort(-number, kind="stable")[:SIGNS]
        if len(top) < 3:
            return rows
        place = np.full(len(number), -1)
        place[top] = np.arange(len(top))
        line, code, _ = words.asked(rows)
        met = place[code] >= 0
        have = np.zeros((len(rows), len(top)))
        have[line[met], place[code[met]]] = 1.0
        return rows[np.argsort(sides(have), kind="stable")]


def in_parts(
    block: ItemBlock, queries: QueryBlock, words: WordScores, rows: np.ndarray, matrix: np.ndarray | None, some: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, Part, np.ndarray | None]]:
    """Rows of queries, a few at a time, the items that they meet, and which of these each row permits.

    ``some`` are the only items to meet, by default all; without the last, all of them are permitted.
    """
    asked = np.zeros(len(queries.ids), dtype=bool)
    asked[rows] = True
    groups = [(number, members[asked[members]]) for number, members in queries.by_filter]
    kind = "all" if some is None else "some"
    own = [(n, m) for n, m in groups if len(m) >= _FEW_QUERIES or block.free(n)]
    rest = [(n, m) for n, m in groups if len(m) < _FEW_QUERIES and not block.free(n)]
    # A filter set of many queries has a part of its own.
    runs = [(block.part((None if block.free(n) else n, kind, matrix is not None), lambda n=n: block.permitted(n, some), matrix), m, None) for n, m in own if len(m)]
    if sum(len(m) for _, m in rest):
        part = block.part((None, kind, matrix is not None), lambda: block.permitted(None, some), matrix)
        masks, mask = np.zeros((len(rest), block.num_rows), dtype=bool), np.zeros(len(queries.ids), dtype=int)
        for line, (number, members) in enumerate(rest):
            masks[line, block.permitted(number)], mask[members] = True, line
        runs.append((part, np.concatenate([m for _, m in rest]), (masks[:, part.at], mask)))
    for part, members, given in runs:
        if not len(part.at):
            continue
        step = max(1, _AT_ONCE // len(part.at))
        if len(members) > step:
            members = part.alike(words, members)
        for first in range(0, len(members), step):
            some_rows = members[first : first + step]
            yield some_rows, part, None if given is None else given[0][given[1][some_rows]]
