"""Token ids of a corpus as flat binary files with 64-bit document offsets.

A folder holds, for each part, three files named in the table ``parts``:
``.ids`` (little-endian unsigned 16- or 32-bit ids, documents one after another),
``.idx`` (unsigned 64-bit offsets into it, one more than documents) and ``.docs``
(Arrow file with the documents' ids). Parts are in ascending order of ``doc_id``;
``base`` of a part, a prefix sum over the parts before it, makes its offsets global.

Nulls: a null text is an empty one (its end id only); null ``doc_id`` come first and
stay null. Rows that repeat a ``doc_id`` follow each other by text, each with ids of
its own. An empty table gives no part. Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortlist.llm.library_coder import LibraryCoder
from shortlist.llm.pretokens import ragged
from shortlist.llm.storage import file_system, open_map

PARTS = "part int, name string, width int, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"
BLOCK_TOKENS = 1 << 20


def with_end(flat, counts, end_id: int):
    """The ids with ``end_id`` after each document, and the new counts."""
    import numpy as np

    longer = counts + 1
    out = np.full(int(longer.sum()), end_id, np.uint32)
    out[ragged(np.cumsum(longer) - longer, counts)] = flat
    return out, longer


def _writer(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        coder, system, docs = None, None, 0
        part = TaskContext.get().partitionId()
        name, total = f"part-{part:05d}-{uuid.uuid4().hex}", 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if coder is None:
                coder = LibraryCoder(tokenizer)
                width = 2 if max(coder.size, end_id + 1) <= 1 << 16 else 4
                system, path = file_system(folder)
                ids_file = system.open_output_stream(f"{path}/{name}.ids", compression=None)
                idx_file = system.open_output_stream(f"{path}/{name}.idx", compression=None)
                idx_file.write(np.zeros(1, "<u8").tobytes())
                doc_file = system.open_output_stream(f"{path}/{name}.docs", compression=None)
                schema = pa.schema([("doc_id", pa.int64())])
                doc_rows = pa.ipc.new_file(doc_file, schema)
            for flat, counts in coder.encode(batch.column("text").to_pylist()):
                flat, counts = with_end(flat, counts, end_id)
                ids_file.write(flat.astype(f"<u{width}").tobytes())
                idx_file.write((total + np.cumsum(counts)).astype("<u8").tobytes())
                total += int(counts.sum())
            doc_rows.write_batch(pa.record_batch([batch.column("doc_id")], schema=schema))
            docs += batch.num_rows
        if coder is None:
            return
        doc_rows.close()
        for file in (ids_file, idx_file, doc_file):
            file.close()
        columns = [pa.array([v], t) for v, t in ((part, pa.int32()), (name, pa.string()), (width, pa.int32()))]
        columns += [pa.array([docs], pa.int64()), pa.array([total], pa.int64())]
        yield pa.record_batch(columns, names=["part", "name", "width", "n_docs", "n_tokens"])

    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encode all documents into ``folder``; returns its table of parts with bases.

    Texts are range-partitioned by ``doc_id``, so each task writes one part front to
    back. A task that runs again writes files of another name; only the names in the
    committed table count.
    """
    spark = docs.sparkSession
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    parts = ordered.mapInArrow(_writer(folder, tokenizer, end_id), PARTS)
    parts.write.parquet(f"{folder}/parts")
    return open_parts(spark, folder)


def open_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The table of parts of a written folder; ``base`` counts the ids before a part."""
    parts = spark.read.schema(PARTS).parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(folder: str):
    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                system, path = file_system(folder)
                stem, width = f"{path}/{row['name']}", row["width"]
                docs = pa.ipc.open_file(open_map(system, stem + ".docs")).read_all()["doc_id"]
                with open_map(system, stem + ".idx") as file:
                    offsets = np.frombuffer(file.read_buffer(8 * (row["n_docs"] + 1)), "<u8").astype(np.int64)
                with open_map(system, stem + ".ids") as ids:
                    first = 0
                    while first < row["n_docs"]:
                        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_TOKENS, "right")) - 1
                        last = min(max(last, first + 1), row["n_docs"])
                        ids.seek(int(offsets[first]) * width)
                        size = int(offsets[last] - offsets[first])
                        block = np.frombuffer(ids.read_buffer(size * width), f"<u{width}").astype("<u4")
                        at = offsets[first : last + 1] - offsets[first]
                        crc = [zlib.crc32(block[a:b].tobytes()) for a, b in zip(at[:-1], at[1:])]
                        starts = row["base"] + offsets[first:last]
                        yield pa.record_batch(
                            [
                                docs.slice(first, last - first).combine_chunks(),
                                pa.array(starts, pa.int64()),
                                pa.array(np.diff(at), pa.int64()),
                                pa.array(crc, pa.int64()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        first = last

    return read


def read_documents(parts: DataFrame, folder: str) -> DataFrame:
    """One row per document from the files: where it starts, its length and checksum."""
    # A number given keeps small rows that stand for large files from being put together.
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = parts.select("part", "name", "width", "n_docs", "base").repartition(tasks, "part")
    return spread.mapInArrow(_reader(folder), ROWS)
