"""BPE encoding and decoding of a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.bpe import WordBpe

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"


def _code(tokenizer: str, decode: bool):
    def code(batches):
        import numpy as np
        import pyarrow as pa

        bpe = None
        for batch in batches:
            bpe = bpe or WordBpe(tokenizer)
            done = 0
            for flat, counts in bpe.encode(batch.column("text").to_pylist()):
                ends = np.cumsum(counts)
                parts = [flat[e - n : e] for e, n in zip(ends, counts)]
                texts = [bpe.decode(ids.tolist()) if decode else None for ids in parts]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(done, len(counts)),
                        pa.array(counts, pa.int64()),
                        pa.array([ids.astype("<u4").tobytes() for ids in parts], pa.binary()),
                        pa.array(texts, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                done += len(counts)

    return code


def encode_documents(docs: DataFrame, tokenizer: str, decode: bool = True) -> DataFrame:
    """Ids (little-endian unsigned 32-bit) of every whole text and their decoded text.

    One row per input row. A null text counts as empty (no ids, empty decoded text);
    a null ``doc_id`` stays null; repeated rows give repeated rows; other columns are
    ignored; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_code(tokenizer, decode), SCHEMA)
