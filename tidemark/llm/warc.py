"""WARC records in seekable Zstandard bundles.

Records are grouped into independent frames of about ``FRAME_BYTES``; a bundle ends with a skippable frame that holds the
seek table (sizes of all frames, then their number, a flag byte and the magic number of the public seekable format). The
index maps a record's key to bundle, frame and offset within the frame, so one record costs one frame.

Records with equal payloads of at least ``least_bytes``: the one with the smallest key is a ``response``, the others are
``revisit`` records without payload that name it. Rows that repeat that smallest key are responses as well. A null
key refers to the smallest key of its payload; where all keys are null, all are responses.
A null payload is an empty one. Null URLs get an empty target. Empty table: no bundle, empty result. Bundles go to the
folder of ``spark.checkpoint.dir`` through a file system that executors open by URI; a task writes under a name of its own
and renames the complete file, and only names in the written index are read, so retried tasks do no harm.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_schema, shared_dir, slices, written

FRAME_BYTES, BUNDLE_BYTES, LEVEL, TASK_BYTES = 1 << 20, 128 << 20, 3, 128 << 20
#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "key long, bundle string, frame int, frame_start long, offset int, length int"
RECORD = "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_id(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'record/{key}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit, whose block holds HTTP headers only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key)), ("WARC-Date", _DATE), ("WARC-Target-URI", target)]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", len(payload))]
    fields += [("X-Record-Key", key)] if key is not None else []
    if refers_to is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Key", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes, start: int = 0) -> tuple[dict, int]:
    """The record that begins at ``start``, checked against its digest, and where the next begins."""
    head_end = data.index(b"\r\n\r\n", start) + 4
    lines = data[start : head_end - 4].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {start}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    end = head_end + int(fields["Content-Length"])
    body = data.index(b"\r\n\r\n", head_end) + 4
    number = lambda name: int(fields[name]) if name in fields else None
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    payload = data[body:end] if kind == "response" else None
    size = number("X-Payload-Length")
    if payload is not None:
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of record {fields['WARC-Record-ID']} does not match its digest")
        size = len(payload)
    row = {"key": number("X-Record-Key"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Key"), "url": fields["WARC-Target-URI"], "payload": payload}
    return row, end + 4


class BundleWriter:
    """Collects records into frames; ``close`` appends the seek table."""

    def __init__(self, out: io.RawIOBase, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.out, self.frame_bytes, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.buffer, self.size, self.frames, self.position = [], 0, [], 0

    def add(self, record: bytes) -> tuple[int, int, int, int]:
        """(frame, where the frame starts in the file, offset in the frame, length)."""
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = (len(self.frames), self.position, self.size, len(record))
        self.buffer.append(record)
        self.size += len(record)
        return place

    def flush(self) -> None:
        if self.buffer:
            frame = self.zstd.compress(b"".join(self.buffer))
            self.out.write(frame)
            self.frames.append((len(frame), self.size))
            self.position += len(frame)
            self.buffer, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)


def read_seek_table(file: pa.NativeFile, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed size, size) of each frame, from the end of the file."""
    file.seek(size - 9)
    count, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * count)
    frames, start = [], 0
    for compressed, plain in struct.iter_unpack("<II", file.read(8 * count)):
        frames.append((start, compressed, plain))
        start += compressed
    return frames


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def with_referrals(pages: DataFrame, key: str, url: str, payload: str, least_bytes: int) -> DataFrame:
    """(key, url, payload, refers_to): the smallest key of equal payloads, where it is not the row's own."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.concat(F.sha1("payload"), F.lit("-"), F.octet_length("payload")))
    first = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    joined = rows.join(first, "digest", "left")
    return joined.select("key", "url", "payload", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(rows: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, level: int = LEVEL, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write rows of (key, url, payload, refers_to) as bundles into ``folder``; returns their index (``INDEX``).

    Each task writes bundles of about ``bundle_bytes`` of records, one after the other; memory holds one frame.
    """
    target = arrow_schema(rows.sparkSession, INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _opened(folder)
        filesystem.create_dir(base, recursive=True)
        writer = name = None
        found: list[tuple] = []
        written_bytes = 0

        def finish() -> pa.RecordBatch:
            writer.close()
            writer.out.close()
            filesystem.move(f"{base}/{name}.part", f"{base}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found, strict=True), target, strict=True)], schema=target)

        for batch in slices(batches, 64):
            for key, url, payload, refers_to in zip(*(batch.column(n).to_pylist() for n in ("key", "url", "payload", "refers_to")), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    writer, found, written_bytes = BundleWriter(filesystem.open_output_stream(f"{base}/{name}.part"), frame_bytes, level), [], 0
                record = encode_record(key, url, payload, refers_to)
                frame, start, offset, length = writer.add(record)
                found.append((key, name, frame, start, offset, length))
                written_bytes += length
                if written_bytes >= bundle_bytes:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return rows.mapInArrow(run, INDEX)


def _tasks(spark: SparkSession, index: DataFrame) -> int:
    """How many tasks read an archive: one for each ``TASK_BYTES`` of records, and not fewer than there are cores, if there are as many frames."""
    size, frames = index.agg(F.sum("length"), F.count_distinct("bundle", "frame")).first()
    return max(1, min(frames, max(2 * spark.sparkContext.defaultParallelism, -(-(size or 0) // TASK_BYTES))))


def read_bundles(spark: SparkSession, folder: str, index: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records (``RECORD``) of the bundles that the index names, one after the other, by the bundles' own seek tables.

    A task takes some frames. Payloads are always read and checked; without ``with_payload`` they are left out.
    """
    target = arrow_schema(spark, RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _opened(folder)
        unzip, tables = zstandard.ZstdDecompressor(), {}
        for batch in batches:
            for name, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with filesystem.open_input_file(f"{base}/{name}") as file:
                    if name not in tables:
                        tables = {name: read_seek_table(file, filesystem.get_file_info(f"{base}/{name}").size)}
                    start, compressed, plain = tables[name][frame]
                    file.seek(start)
                    data, at, rows = unzip.decompress(file.read(compressed), max_output_size=plain), 0, []
                while at < len(data):
                    row, at = decode_record(data, at)
                    rows.append(row if with_payload else row | {"payload": None})
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    frames = index.select("bundle", "frame").distinct().repartition(_tasks(spark, index), "bundle", "frame")
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(run, RECORD)


def fetch(spark: SparkSession, folder: str, places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records whose index rows ``places`` holds, by their offsets: each costs one seek and at most one frame.

    Rows of one frame follow each other in one task, so no frame is read twice.
    """
    target = arrow_schema(spark, RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = _opened(folder)
        unzip = zstandard.ZstdDecompressor()
        rows, held, last, data = [], 0, None, b""
        for batch in slices(batches):
            for place in batch.to_pylist():
                if (at := (place["bundle"], place["frame_start"])) != last:
                    with filesystem.open_input_file(f"{base}/{at[0]}") as file:
                        file.seek(at[1])
                        data, last = unzip.stream_reader(file, read_across_frames=False).read(), at
                row = decode_record(data, place["offset"])[0]
                if row["key"] != place["key"]:
                    raise ValueError(f"the index has no record {place['key']} at {place['offset']} of frame {place['frame']} in {at[0]}")
                rows.append(row if with_payload else row | {"payload": None})
                held += place["length"]
                if held >= FRAME_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=target)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=target)

    dealt = places.repartition(_tasks(spark, places), "bundle", "frame")
    return dealt.sortWithinPartitions("bundle", "frame_start", "offset").mapInArrow(run, RECORD)


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write every row as a record; returns the bundles' folder and the index, itself a written table."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    return folder, written(spark, write_bundles(with_referrals(pages, key, url, payload, least_bytes), folder), "warc-index")


def op3(pages: DataFrame) -> DataFrame:
    """Every record, found again by its index entry."""
    folder, index = archive(pages)
    return fetch(pages.sparkSession, folder, index, with_payload=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Five hex digits are four base-32 letters.
ORACLE_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha1(body) as hex, body, min(page_id) over (partition by body) as first_id from p),
b as (
  select *, array_to_string(list_transform(list_transform(range(0, 8), lambda i: cast('0x' || substr(hex, cast(i * 5 + 1 as bigint), 5) as bigint)), lambda v:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)), '') as payload_digest
  from d
)
select page_id, payload_bytes, payload_digest, case when page_id is not distinct from first_id then 'response' else 'revisit' end as record_type,
  case when page_id is distinct from first_id then first_id end as refers_to
from b
"""
