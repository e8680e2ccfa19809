"""Packing documents into training sequences along a space-filling curve.

Each document's token ids are hashed into a vector, the vector is projected to a few
dimensions, and its cell on a Hilbert curve is its sort key, so documents of like
content are neighbours. Laid end to end in that order, the corpus is one long run of
ids, cut every ``SEQUENCE`` ids; the rest at the very end is cut at powers of two.
No sequence needs padding.

Only (row, key, length) is sorted; the ids are moved once, to meet their places.

Nulls: a null text is an empty one (its end id only). Null ``doc_id`` are packed like
others. Repeated rows are packed once each. Ties on the curve follow ``doc_id``, then
the row's place in the input. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.hilbert import hilbert_keys
from shortlist.llm.library_coder import LibraryCoder
from shortlist.llm.storage import new_folder
from shortlist.llm.token_files import with_end
from shortlist.session import materialize

SEQUENCE = 4096
BUCKETS, DIMS, BITS = 256, 3, 16
CODED = "doc_id long, n_tokens long, key long, ids binary"
PLACED = "row long, start long, n_tokens long, part int"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long, ids binary"
)


def _curve_keys(flat, counts, vocabulary: int):
    """Hilbert key of each document from its ids."""
    import numpy as np

    rng = np.random.default_rng(7)
    bucket = rng.integers(0, BUCKETS, vocabulary)
    sign = rng.choice([-1.0, 1.0], vocabulary)
    project = rng.normal(size=(BUCKETS, DIMS))
    cell = np.repeat(np.arange(len(counts)) * BUCKETS, counts) + bucket[flat]
    vectors = np.bincount(cell, sign[flat], len(counts) * BUCKETS).reshape(len(counts), BUCKETS)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    # Of a unit vector, each coordinate spreads about one standard normal wide.
    at = (vectors / np.where(norm == 0, 1, norm)) @ project
    cells = np.clip((at / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_keys(cells, BITS)


def _coder(tokenizer: str, end_id: int):
    def code(batches):
        import numpy as np
        import pyarrow as pa

        coder = None
        for batch in batches:
            coder = coder or LibraryCoder(tokenizer)
            width = 2 if max(coder.size, end_id + 1) <= 1 << 16 else 4
            done = 0
            for flat, counts in coder.encode(batch.column("text").to_pylist()):
                keys = _curve_keys(flat, counts, coder.size)
                flat, counts = with_end(flat, counts, end_id)
                data = flat.astype(f"<u{width}").tobytes()
                offsets = np.concatenate([[0], np.cumsum(counts) * width]).astype(np.int32)
                ids = pa.Array.from_buffers(
                    pa.binary(), len(counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]
                )
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(done, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.int64()),
                        ids,
                    ],
                    names=["doc_id", "n_tokens", "key", "ids"],
                )
                done += len(counts)

    return code


def _place(batches):
    """Running starts within one range partition, in its order."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, total = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        starts = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.record_batch(
            [
                batch.column("row"),
                pa.array(starts, pa.int64()),
                batch.column("n_tokens"),
                pa.array(np.full(len(n), part), pa.int32()),
            ],
            names=["row", "start", "n_tokens", "part"],
        )


def sequence_edges(total: int) -> tuple[int, list[int]]:
    """Where whole sequences end, and the starts of the power-of-two ones after them."""
    full = total // SEQUENCE * SEQUENCE
    starts, at, rest = [], full, total - full
    while rest:
        starts.append(at)
        step = 1 << (rest.bit_length() - 1)
        at, rest = at + step, rest - step
    return full, starts


def _cutter(total: int):
    full, tail = sequence_edges(total)
    edges = [*tail, total]

    def pieces_of(start: int, end: int):
        """(first, last, sequence, offset) of each piece of the ids ``start .. end``."""
        at = start
        while at < end:
            if at < full:
                seq, offset = divmod(at, SEQUENCE)
                stop = at - offset + SEQUENCE
            else:
                i = max(j for j, t in enumerate(tail) if t <= at)
                seq, offset, stop = full // SEQUENCE + i, at - tail[i], edges[i + 1]
            stop = min(stop, end)
            yield at, stop, seq, offset
            at = stop

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            starts, counts = batch.column("at").to_pylist(), batch.column("n_tokens").to_pylist()
            docs = batch.column("doc_id")
            owner, rows, blobs = [], [], []
            for i, (start, n) in enumerate(zip(starts, counts)):
                data = batch.column("ids")[i].as_py()
                ids = np.frombuffer(data, f"<u{len(data) // n}").astype("<u4")
                for a, b, seq, offset in pieces_of(start, start + n):
                    blob = ids[a - start : b - start].tobytes()
                    owner.append(i)
                    blobs.append(blob)
                    rows.append((a - start, b - a, zlib.crc32(blob), n, seq, offset))
            if rows:
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
                yield pa.record_batch(
                    [docs.take(pa.array(owner)), *columns, pa.array(blobs, pa.binary())],
                    names=[c.split()[0] for c in PIECES.split(",")],
                )

    return cut


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Pieces of all documents with their sequence, offset there, and ids."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    folder = new_folder(spark, "packing")
    coded = rows.mapInArrow(_coder(tokenizer, end_id), CODED)
    # The row number is stored, so it is the same for both uses below.
    coded.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    coded = spark.read.schema(f"{CODED}, row long").parquet(folder)
    light = coded.select("row", "key", "doc_id", "n_tokens")
    ordered = light.repartitionByRange("key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = materialize(ordered.select("row", "n_tokens").mapInArrow(_place, PLACED))
    sizes = placed.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    # One row per range partition from here.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    total = coded.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    places = placed.join(F.broadcast(bases), "part").select("row", (F.col("start") + F.col("base")).alias("at"))
    found = coded.join(places.hint("shuffle_hash"), "row").select("doc_id", "n_tokens", "at", "ids")
    return found.mapInArrow(_cutter(total), PIECES)
