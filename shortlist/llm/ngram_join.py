"""Near-duplicate documents by the Jaccard similarity of their runs of five words.

Texts with the same words are one class member with a weight. Of each, min-hashes in
bands are taken; how many bands of how many rows follows from the similarity and the
recall asked for. Members that share a band are candidates. Candidates that hang
together form a cell, and inside a cell every pair is verified on the full sets of
shingles, by matrix products over blocks of members, so no pair becomes a row. A large
cell is cut into blocks, and each pair of blocks is a task of its own.

The result has one row per input row: ``class_id`` (the least ``doc_id`` of those that
verified links connect) and ``n_links`` (other rows at or above the similarity, copies
included).

Nulls: a null text has no words. All texts without words are copies of each other. A
text of fewer than five words has one shingle, all its words. Rows with a null
``doc_id`` take no part: their class is null, their links 0. Rows that repeat a
``doc_id`` are copies if their words are the same, else members linked like others. An
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.llm.graph import components
from shortlist.llm.pretokens import slices
from shortlist.llm.shingles import text_shingles
from shortlist.llm.storage import new_folder
from shortlist.session import materialize

SIMILARITY, RECALL, MAX_HASHES = 0.8, 0.99, 256
BLOCK = 1024
BIN = 1024
COLUMNS = 4096
MARKS = "doc_id long, text_hash long, words binary, bands array<long>"
SETS = "cell long, blocks int, node long, weight long, shingles binary"
FOUND = "node long, root long, n_links long"


def choose_bands(similarity: float, recall: float, most: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows for which ``most`` hashes reach the recall."""
    best = None
    for rows in range(1, most + 1):
        one = similarity**rows
        if one < 1e-15:
            break
        bands = math.ceil(math.log(1 - recall) / math.log1p(-one)) if one < 1 else 1
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def min_hash_bands(shingles, counts, bands: int, rows: int):
    """One 64-bit value per text and band."""
    import numpy as np

    rng = np.random.default_rng(11)
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    first = np.cumsum(counts) - counts
    out = np.zeros((len(counts), bands), np.uint64)
    turned = np.empty_like(x)
    for b in range(bands):
        value = np.full(len(counts), b + 1, np.uint64)
        for _ in range(rows):
            flip = np.uint32(rng.integers(1 << 32))
            odd = np.uint32(rng.integers(1 << 31) * 2 + 1)
            np.bitwise_xor(x, flip, out=turned)
            np.multiply(turned, odd, out=turned)
            least = np.minimum.reduceat(turned, first)
            value = (value ^ least) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
        out[:, b] = value
    return out


def _marker(bands: int, rows: int):
    def mark(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in batches:
            done = 0
            for run in slices(batch.column("text").to_pylist()):
                shingles, windows, words, counts = text_shingles(run)
                values = min_hash_bands(shingles, windows, bands, rows).astype(np.int64)
                ends = np.cumsum(counts)
                keys = [xxhash.xxh128_digest(words[e - n : e].tobytes()) for e, n in zip(ends, counts)]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(done, len(run)),
                        batch.column("text_hash").slice(done, len(run)),
                        pa.array(keys, pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array(np.arange(0, values.size + 1, bands), pa.int32()), pa.array(values.ravel())
                        ),
                    ],
                    names=["doc_id", "text_hash", "words", "bands"],
                )
                done += len(run)

    return mark


def _shingle_sets(batches):
    """Sets of the rows whose words are those of their member."""
    import numpy as np
    import pyarrow as pa
    import xxhash

    names = ["cell", "blocks", "node", "weight"]
    for batch in batches:
        done, wanted = 0, batch.column("words").to_pylist()
        for run in slices(batch.column("text").to_pylist()):
            shingles, windows, words, counts = text_shingles(run)
            ends, last = np.cumsum(windows), np.cumsum(counts)
            rows, sets = [], []
            for i in range(len(run)):
                if xxhash.xxh128_digest(words[last[i] - counts[i] : last[i]].tobytes()) == wanted[done + i]:
                    rows.append(done + i)
                    sets.append(np.unique(shingles[ends[i] - windows[i] : ends[i]]).tobytes())
            columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in names]
            yield pa.record_batch([*columns, pa.array(sets, pa.binary())], names=[*names, "shingles"])
            done += len(run)


def _linked(sets, split: int | None, similarity: float):
    """Matrix of verified links; with ``split``, only between the rows before and after it."""
    import numpy as np
    import pandas as pd

    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes, _ = pd.factorize(np.concatenate(sets))
    # A shingle of one member is in no intersection.
    often = np.bincount(codes)
    keep = often[codes] > 1
    owner, codes = owner[keep], np.unique(codes[keep], return_inverse=True)[1]
    top = slice(0, split if split is not None else len(sets))
    side = slice(split if split is not None else 0, len(sets))
    both = np.zeros((len(sizes[top]), len(sizes[side])), np.float32)
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    n_codes = int(codes[-1]) + 1 if len(codes) else 0
    for first in range(0, n_codes, COLUMNS):
        a, b = np.searchsorted(codes, [first, first + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, n_codes - first)), np.float32)
        has[owner[a:b], codes[a:b] - first] = 1
        both += has[top] @ has[side].T
    share = similarity / (1 + similarity)
    return both >= share * (sizes[top][:, None] + sizes[side][None, :]) - 1e-6


def _roots(links, ids):
    """Least id that each row reaches over the links of a (square) matrix."""
    import numpy as np

    root = ids.copy()
    big = np.iinfo(np.int64).max
    todo = np.ones(len(ids), bool)
    while todo.any():
        new = np.minimum(root, np.where(links[:, todo], root[todo][None, :], big).min(1))
        todo = new != root
        root = new
    return root


def _verifier(similarity: float):
    def verify(pdf):
        """All cells of a bin, or one pair of blocks of a large cell."""
        import numpy as np
        import pandas as pd

        one_block = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        out = []
        for _, rows in pdf.groupby("cell", sort=False):
            # Repeated rows of a document bring the same set twice.
            rows = rows.drop_duplicates("node").sort_values(["side", "node"], kind="stable")
            sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
            nodes, weight = rows["node"].to_numpy(), rows["weight"].to_numpy()
            if one_block:
                links = _linked(sets, None, similarity)
                np.fill_diagonal(links, False)
            else:
                split = int((rows["side"] == 0).sum())
                if split in (0, len(rows)):
                    continue
                across = _linked(sets, split, similarity)
                links = np.zeros((len(nodes), len(nodes)), bool)
                links[:split, split:], links[split:, :split] = across, across.T
            found = {"node": nodes, "root": _roots(links, nodes), "n_links": links @ weight}
            out.append(pd.DataFrame(found))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "root": [], "n_links": []})

    return verify


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links of every document."""
    marks, per_text = _classified(docs, similarity, recall)
    rows = marks.select("doc_id", "words").join(per_text.select("words", "class_id", "n_links"), "words", "left")
    known = F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id", F.when(known, F.col("class_id")).alias("class_id"),
        F.when(known, F.col("n_links")).otherwise(0).alias("n_links"),
    )


def text_hash(text: Column) -> Column:
    """Tells texts of one ``doc_id`` apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def firsts(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id and text_hash of the row kept of each class: that with the least of both."""
    _, per_text = _classified(docs, similarity, recall)
    return per_text.where("is_first").select(F.col("first").alias("doc_id"), "text_hash")


def _classified(docs: DataFrame, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Marks of all rows, and the class of each distinct text."""
    spark = docs.sparkSession
    bands, band_rows = choose_bands(similarity, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = new_folder(spark, "marks")
    texts = texts.withColumn("text_hash", text_hash(F.col("text")))
    texts.mapInArrow(_marker(bands, band_rows), MARKS).write.parquet(folder)
    texts = texts.drop("text_hash")
    marks = spark.read.schema(MARKS).parquet(folder)
    # One member per distinct text, numbered once it is stored.
    members = marks.where("doc_id is not null").groupBy("words")
    members = members.agg(
        F.min(F.struct("doc_id", "text_hash")).alias("least"), F.count("*").alias("weight"), F.first("bands").alias("bands")
    )
    members = members.select("words", F.col("least.doc_id").alias("first"), "least.text_hash", "weight", "bands")
    members = materialize(members.withColumn("node", F.monotonically_increasing_id()))
    cells = components(_band_edges(members))
    cells = materialize(cells.select("node", F.col("root").alias("cell")))
    found = materialize(_verify(texts, members, cells, similarity))
    return marks, _classes(members.drop("bands"), found)


def _band_edges(members: DataFrame) -> DataFrame:
    """Each member of a shared band with the least member there."""
    shared = members.select("node", F.posexplode("bands").alias("band", "value"))
    shared = shared.select("node", F.xxhash64("band", "value").alias("bucket"))
    least = shared.groupBy("bucket").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    # A left join keeps a large bucket splittable.
    edges = shared.join(least.drop("n"), "bucket", "left").where("least < node")
    return edges.select(F.col("node").alias("u"), F.col("least").alias("v"))


def _verify(texts: DataFrame, members: DataFrame, cells: DataFrame, similarity: float) -> DataFrame:
    """Links of each member inside its cell, and the least member it reaches there."""
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = members.select("node", "first", "weight", "words")
    placed = cells.join(sizes, "cell", "left").join(member, "node")
    bins = max(1, cells.count() // BIN)
    sets = texts.join(placed, texts["doc_id"] == placed["first"])
    sets = sets.select("cell", "blocks", "node", "weight", "words", "text").mapInArrow(_shingle_sets, SETS)
    kept = ["cell", "node", "weight", "shingles"]
    small = sets.where("blocks = 1").select(
        (-1 - F.pmod(F.xxhash64("cell"), F.lit(bins))).alias("task"), F.lit(0).alias("a"), F.lit(0).alias("b"),
        F.lit(0).alias("side"), *kept,
    )
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    large = sets.where("blocks > 1").withColumn("mine", mine)
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select(
        F.col("cell").alias("task"), F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), *kept,
    )
    # A block meets itself on side 0 only, so its own pairs are verified once.
    work = small.unionByName(large)
    return work.groupBy("task", "a", "b").applyInPandas(_verifier(similarity), FOUND)


def _classes(members: DataFrame, found: DataFrame) -> DataFrame:
    """class_id, n_links, is_first of each member: links summed over blocks, classes joined."""
    links = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    linked = members.join(roots, "node", "left").join(links, "node", "left")
    linked = linked.withColumn("root", F.coalesce("root", "node"))
    mine = F.struct("first", "text_hash")
    least = linked.groupBy("root").agg(F.min(mine).alias("least"))
    others = F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1
    return linked.join(least, "root", "left").select(
        "words", "first", "text_hash", F.col("least.first").alias("class_id"), others.alias("n_links"),
        (mine == F.col("least")).alias("is_first"),
    )
