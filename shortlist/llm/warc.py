"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME_BYTES``; each frame is compressed on
its own, and a seek table in a skippable frame at the end of the file (the public
seekable format) gives the size of each. An index table maps a record to its bundle,
frame and place inside the unpacked frame, so one record costs one frame to read.

Of records with equal payloads of at least ``least`` bytes, that with the smallest
``page_id`` is a ``response`` and all others are ``revisit`` records that refer to it;
smaller payloads are always responses. Rows that repeat the smallest ``page_id`` are
all responses.

Nulls: a null html is an empty payload; a null url leaves the target header out; a null
``page_id`` is never referred to, and such rows are responses if no other id holds the
payload. An empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm.storage import file_system, open_map

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 30
INDEX = "page_id long, bundle string, frame int, frame_start long, frame_size long, at long, size long"
RECORDS = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary"
# Fixed values of the public formats.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
ID = "urn:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit has no block; the payload's length stays in a header."""
    block = b"" if is_revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Payload-Length: {len(payload)}",
    ]
    if url is not None:
        # A line break would end the header.
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if is_revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <{ID}{refers_to}>")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    number = lambda name: (t := fields.get(name, "")[len(ID) + 1 : -1]) and int(t) or (0 if t else None)
    return {
        "page_id": number("WARC-Record-ID"),
        "record_type": fields["WARC-Type"],
        "payload_bytes": int(fields["Payload-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": number("WARC-Refers-To"),
        "url": fields.get("WARC-Target-URI"),
        "payload": rest[: int(fields["Content-Length"])],
    }


class BundleWriter:
    """Frames, seek table and index rows of one bundle."""

    def __init__(self, system, path: str, name: str):
        import zstandard

        self.file = system.open_output_stream(f"{path}/{name}", compression=None)
        self.name, self.pack = name, zstandard.ZstdCompressor(level=3)
        self.frames, self.start = [], 0
        self.buffer, self.size, self.waiting = [], 0, []

    def add(self, page_id, record: bytes) -> list[tuple]:
        self.waiting.append((page_id, self.size, len(record)))
        self.buffer.append(record)
        self.size += len(record)
        return self.flush() if self.size >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        """Closes a frame; returns the index rows of its records."""
        if not self.buffer:
            return []
        packed = self.pack.compress(b"".join(self.buffer))
        self.file.write(packed)
        rows = [(i, self.name, len(self.frames), self.start, len(packed), at, n) for i, at, n in self.waiting]
        self.frames.append((len(packed), self.size))
        self.start += len(packed)
        self.buffer, self.size, self.waiting = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.file.close()
        return rows


def read_seek_table(file) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of each frame, from the end of a bundle."""
    end = file.size()
    file.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * n)
    sizes = struct.unpack(f"<{2 * n}I", file.read(8 * n))
    out, start = [], 0
    for packed, size in zip(sizes[::2], sizes[1::2]):
        out.append((start, packed, size))
        start += packed
    return out


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with ``refers_to``: the id of the response that a revisit repeats, else null."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")
    )
    payload = F.encode("html", "UTF-8")
    mark = F.concat_ws(":", F.sha1(payload), F.octet_length("html"))
    rows = rows.withColumn("mark", F.when(F.octet_length("html") >= least, mark))
    # Counts combine before the shuffle; only payloads met twice go on.
    seen = rows.where("mark is not null").select("page_id", "mark").groupBy("mark")
    firsts = seen.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    held = rows.join(firsts.drop("n"), "mark", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return held.select("page_id", "url", "html", refers.alias("refers_to"))


def _writer(folder: str):
    def write(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
        names = [c.split()[0] for c in INDEX.split(", ")]

        def table(rows):
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        system, path = file_system(folder)
        bundle = None
        for batch in batches:
            for row in batch.to_pylist():
                if bundle is None:
                    bundle = BundleWriter(system, path, f"bundle-{uuid.uuid4().hex}.warc.zst")
                payload, refers = row["html"].encode(), row["refers_to"]
                data = record_bytes(row["page_id"], row["url"], payload, refers, refers is not None)
                if rows := bundle.add(row["page_id"], data):
                    yield table(rows)
                    if bundle.start >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
        if bundle is not None and (rows := bundle.close()):
            yield table(rows)

    return write


def write_bundles(records: DataFrame, folder: str) -> DataFrame:
    """Write planned records into ``folder``; returns the stored index.

    A task that runs again writes bundles of other names; only those in the index count.
    """
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    index = records.mapInArrow(_writer(folder), INDEX)
    index.write.parquet(f"{folder}/index")
    return records.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def _batch(rows: list[dict]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.record_batch([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names=names)


def _unpack(file, start: int, size: int) -> bytes:
    import zstandard

    file.seek(start)
    return zstandard.ZstdDecompressor().decompress(file.read(size))


def _scanner(folder: str):
    def scan(batches):
        system, path = file_system(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with open_map(system, f"{path}/{name}") as file:
                    for start, packed, _ in read_seek_table(file):
                        data, rows, at = _unpack(file, start, packed), [], 0
                        while at < len(data):
                            end = data.index(b"\r\n\r\n", at) + 4
                            n = int(data[at:end].rpartition(b"Content-Length: ")[2])
                            rows.append(parse_record(data[at : end + n + 4]))
                            at = end + n + 4
                        yield _batch(rows)

    return scan


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """All records of all bundles, frame by frame; a task holds one frame at a time."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = index.select("bundle").distinct().repartition(tasks, "bundle")
    return bundles.mapInArrow(_scanner(folder), RECORDS)


def _fetcher(folder: str):
    def fetch(batches):
        system, path = file_system(folder)
        for batch in batches:
            held, data = None, b""
            for row in batch.to_pylist():
                frame = (row["bundle"], row["frame_start"], row["frame_size"])
                if frame != held:
                    with open_map(system, f"{path}/{row['bundle']}") as file:
                        held, data = frame, _unpack(file, *frame[1:])
                yield _batch([parse_record(data[row["at"] : row["at"] + row["size"]])])

    return fetch


def fetch_records(index: DataFrame, ids: DataFrame, folder: str) -> DataFrame:
    """The records of some ``page_id``, each by unpacking its own frame only."""
    wanted = index.join(ids.select("page_id").distinct(), "page_id", "left_semi")
    near = wanted.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "at")
    return near.mapInArrow(_fetcher(folder), RECORDS)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")
