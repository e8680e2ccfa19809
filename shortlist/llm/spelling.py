"""Spelling variants: words of a corpus that differ by one code point, and their forms.

Words are maximal runs of Latin letters, lower-cased in A-Z only, thinned out by a hash
rule (see ``words_of``), counted over all texts. A word's letter counts lie in a block:
its length and how many of its letters fall into each of ``GROUPS`` groups of letters.
One inserted, deleted or replaced letter leads to the same block or to one of a few
others, so a block meets only those: of its own length, and one letter longer. There
NumPy products of the letter-count matrices give the squared distances of all pairs;
pairs at most two apart are kept, and their edits verified letter by letter. Cells of
a block and its neighbours are bounded in bytes on both sides, whatever a block's size.

Nulls: a null text has no words; a null ``doc_id`` counts as an empty one in the hash;
rows that repeat a document are counted each. Ties of a form go to the smaller word. An
empty table gives an empty one. Columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.quality import store
from shortlist.session import materialize, sent_if_few

MIN_LENGTH, MIN_COUNT, RATIO = 5, 3, 2
CUT_EVERY = 97
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{MIN_LENGTH},}}")
# Letters that are left when A-Z are lower-cased, in code-point order.
LETTERS = "".join(map(chr, [*range(0x61, 0x7B), *range(0xC0, 0x100)]))
GROUPS = 4
CELL_BYTES = 24 << 20
MAX_SENT_BLOCKS = 50_000
_AT_ONCE = 1 << 22
_MOST_WORDS = 400_000
NEAR = "word string, n_near long, near_n long, near string"


def count_words(doc_id, text: str, counts: Counter) -> None:
    """Adds the words of one text; runs too short to stay long enough are left out.

    With h the crc32 of ``<doc_id>:<run>``, a run loses its letter h % length if
    ``CUT_EVERY`` divides h.
    """
    base = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    # Lower case of bytes changes A-Z only.
    runs = RUN.findall(text.encode().lower().decode())
    for run, n in Counter(runs).items():
        h = zlib.crc32(run.encode(), base)
        if h % CUT_EVERY == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < MIN_LENGTH:
                continue
        counts[run] += n


def _count_task(batches):
    import pyarrow as pa

    def batch_of(counts):
        words, n = pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())
        return pa.record_batch([words, n], names=["word", "n"])

    counts = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            count_words(doc_id, text, counts)
            if len(counts) > _MOST_WORDS:
                yield batch_of(counts)
                counts = Counter()
    if counts:
        yield batch_of(counts)


def words_of(docs: DataFrame) -> DataFrame:
    """(word, n): words with at least ``MIN_COUNT`` occurrences over all texts."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text is not null")
    counts = rows.mapInArrow(_count_task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _group_counts(word: Column) -> list[Column]:
    parts = (LETTERS[g::GROUPS] for g in range(GROUPS))
    return [F.length(word) - F.length(F.translate(word, part, "")) for part in parts]


def _key(counts) -> Column:
    """Name of a block; its length is the sum of its counts."""
    return F.concat_ws(",", *(c.cast("string") for c in counts))


def _targets(counts: list[Column]) -> Column:
    """Blocks that a word is sent to: those it may be near to, each pair of blocks once.

    Its own; of its length those that come before it, one letter moved to an earlier
    group; and those one letter shorter.
    """

    def moved(change: dict[int, int]) -> Column:
        return _key([c + change.get(g, 0) for g, c in enumerate(counts)])

    none = F.lit(None).cast("string")
    out = [_key(counts)]
    for g, c in enumerate(counts):
        out.append(F.when(c > 0, moved({g: -1})).otherwise(none))
        out += [F.when(c > 0, moved({g: -1, h: 1})).otherwise(none) for h in range(g)]
    return F.array_compact(F.array(*out))


def letter_counts(words: list[str]):
    """(code points by word, letter counts by word) of words of one length."""
    import numpy as np

    place = np.zeros(256, np.int64)
    place[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
    size = len(words[0])
    codes = np.array(words, dtype=f"U{size}").view(np.uint32).reshape(len(words), size).astype(np.uint8)
    at = place[codes] + len(LETTERS) * np.arange(len(words))[:, None]
    counts = np.bincount(at.ravel(), minlength=len(words) * len(LETTERS)).reshape(len(words), -1)
    # Single precision holds squares of counts exactly up to this length.
    return codes, counts.astype(np.float32 if size < 2000 else np.float64)


def one_edit(a, b):
    """Which rows of code points ``a`` and ``b`` differ by one code point.

    Rows of equal length by a replaced one; rows of ``b`` that are one longer by an
    inserted one.
    """
    import numpy as np

    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    size = a.shape[1]
    heads = np.logical_and.accumulate(a == b[:, :size], 1).sum(1)
    tails = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], 1).sum(1)
    return heads + tails >= size


def near_pairs(left: list[str], right: list[str]):
    """(places in ``left``, places in ``right``) of words that are one edit apart.

    The words of a side have one length; those of ``right`` are as long or one longer.
    """
    import numpy as np

    (codes_l, x), (codes_r, y) = letter_counts(left), letter_counts(right)
    squares_l, squares_r = (x * x).sum(1), (y * y).sum(1)
    step = max(1, _AT_ONCE // len(right))
    found = []
    for first in range(0, len(left), step):
        part = slice(first, first + step)
        distance = squares_l[part, None] + squares_r[None, :] - 2 * (x[part] @ y.T)
        i, j = np.nonzero(distance <= 2)
        i += first
        some = max(1, _AT_ONCE // codes_r.shape[1])
        for k in range(0, len(i), some):
            p, q = i[k : k + some], j[k : k + some]
            yes = one_edit(codes_l[p], codes_r[q])
            found.append((p[yes], q[yes]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([none, *side]) for side in (zip(*found) if found else ((), ())))


def _near_schema():
    import pyarrow as pa

    return pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near_n", pa.int64()), ("near", pa.string())])


def _meet(left, right):
    """Near words of one cell: their number and the most frequent, by word.

    A word of the block itself comes on both sides, so its pairs credit the left only.
    """
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    schema = _near_schema()
    words, n = left["word"].to_pylist(), left["n"].to_numpy()
    if not words or not right.num_rows:
        return schema.empty_table()
    others = right.to_pandas()
    own = others["far_block"] == others["cell_block"]
    same = others["far"].str.len() == len(words[0])
    parts = []
    for rows in (own, ~own & same, ~own & ~same):
        far, far_n = others.loc[rows, "far"].to_numpy(object), others.loc[rows, "far_n"].to_numpy()
        if not len(far):
            continue
        i, j = near_pairs(words, far.tolist())
        here = np.array(words, dtype=object)[i]
        parts.append(pd.DataFrame({"word": here, "near_n": far_n[j], "near": far[j]}))
        if rows is not own:
            parts.append(pd.DataFrame({"word": far[j], "near_n": n[i], "near": here}))
    found = pd.concat(parts).sort_values(["word", "near_n", "near"], ascending=[True, False, True])
    groups = found.groupby("word", sort=False)
    out = groups.first().assign(n_near=groups.size()).reset_index()
    return pa.Table.from_pandas(out[schema.names], schema=schema, preserve_index=False)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): number of near words and the most frequent of them."""
    counts = [F.col(f"g{g}") for g in range(GROUPS)]
    grouped = words.select("word", "n", *(c.alias(f"g{g}") for g, c in enumerate(_group_counts(F.col("word")))))
    size = (4 * len(LETTERS) + 16 * F.length("word") + 100).alias("size")
    left = grouped.select("word", "n", _key(counts).alias("cell_block"), size)
    right = grouped.select(
        F.col("word").alias("far"), F.col("n").alias("far_n"), _key(counts).alias("far_block"), size, F.explode(_targets(counts)).alias("cell_block")
    )
    cuts = F.ceil(F.sum("size") / CELL_BYTES).cast("int")
    blocks = left.groupBy("cell_block").agg(cuts.alias("n_left"))
    blocks = blocks.join(right.groupBy("cell_block").agg(cuts.alias("n_right")), "cell_block")
    blocks = sent_if_few(materialize(blocks), MAX_SENT_BLOCKS)

    def cell(word: str, here: str, there: str) -> list[Column]:
        mine = F.pmod(F.xxhash64(word), F.col(here)).cast("int").alias(here)
        return [mine, F.explode(F.sequence(F.lit(0), F.col(there) - 1)).alias(there)]

    keys = ("cell_block", "n_left", "n_right")
    left = left.join(blocks, "cell_block").select("word", "n", "cell_block", *cell("word", "n_left", "n_right"))
    right = right.join(blocks, "cell_block")
    right = right.select("far", "far_n", "far_block", "cell_block", *cell("far", "n_right", "n_left"))
    left = left.select("word", "n", *(F.col(k).alias(f"_{k}") for k in keys))
    met = left.groupBy(*(f"_{k}" for k in keys)).cogroup(right.groupBy(*keys)).applyInArrow(_meet, NEAR)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    sums = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return sums.select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms ends; each round doubles the steps taken.

    A form has at least ``RATIO`` times the count, so chains are short.
    """
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = state.join(on, "root", "left")
        moved = materialize(longer.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return state


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    ``form`` is the near word with the largest n if that is at least ``RATIO`` times
    the word's own, else null; ``root`` is where forms lead to.
    """
    words = store(words_of(docs))
    known = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    rows = known.select(
        "word",
        F.when(is_form, F.col("near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    rows = store(rows)
    joined = rows.join(_roots(rows.where("form is not null")), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
