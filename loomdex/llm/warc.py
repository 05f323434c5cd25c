"""WARC archives in Zstandard frames with a shared dictionary: writer and reader.

An archive file is a skippable frame that holds the dictionary (itself a Zstandard frame, or raw), then one frame
per record. Files lie in a folder all executors reach. A written table lists the files of the attempts that
succeeded, so what a lost executor left behind is never read.

The reader loads the dictionary, decodes frame by frame, and checks of every record: the version line, the
mandatory headers, the content length against the block, the closing line ends, the block and payload digests, and
that one frame holds one record.

Cases: a null payload is empty; equal payloads of at least ``min_bytes`` bytes are kept once, the others are
``revisit`` records that refer to the record with the smallest id (rows that repeat this id are all responses);
a null id is written as none and never referred to, unless all ids of the payload are null; a null url becomes an
empty target; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomdex.llm.common import materialize, shared_folder

#: Magic numbers of the skippable frame that holds the dictionary and of a Zstandard frame.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Version line and profile of records whose payload an earlier record has.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Size of the dictionary, and the payload bytes of an archive's first records that it is trained on.
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("target", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


class ArchiveError(ValueError):
    """A frame or record breaks the format."""


# Records


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(record_id: int | None) -> bytes:
    """Record ids carry the row's id; rows may repeat, so nothing else is unique about them."""
    return b"<urn:row:%s>" % (b"none" if record_id is None else b"%d" % record_id)


def row_of(urn: bytes) -> int | None:
    if not (urn.startswith(b"<urn:row:") and urn.endswith(b">")):
        raise ArchiveError(f"record id {urn!r}")
    return None if urn[9:-1] == b"none" else int(urn[9:-1])


def record_bytes(record_id, target, payload: bytes, refers_to, is_revisit: bool) -> bytes:
    """One record; the HTTP head of a revisit keeps the payload's length."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if is_revisit else head + payload
    lines = [
        VERSION,
        b"WARC-Type: " + (b"revisit" if is_revisit else b"response"),
        b"WARC-Record-ID: " + record_urn(record_id),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Target-URI: " + " ".join((target or "").split()).encode(),
        b"Content-Type: application/http; msgtype=response",
        b"WARC-Block-Digest: sha1:" + base32_sha1(block).encode(),
        b"WARC-Payload-Digest: sha1:" + base32_sha1(payload).encode(),
        b"Content-Length: %d" % len(block),
    ]
    if is_revisit:
        lines += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: " + record_urn(refers_to)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The validated record in ``data``."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] != VERSION:
        raise ArchiveError("no version line or no end of the headers")
    headers: dict[bytes, bytes] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or name.lower() in headers:
            raise ArchiveError(f"header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in (b"warc-type", b"warc-record-id", b"warc-date", b"content-length"):
        if name not in headers:
            raise ArchiveError(f"header {name.decode()} is missing")
    length = int(headers[b"content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ArchiveError(f"content length {length} does not match the record")
    http, found, payload = block.partition(b"\r\n\r\n")
    if not found or not http.startswith(b"HTTP/"):
        raise ArchiveError("the block is no HTTP message")
    payload_bytes = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), -1)
    digest = headers.get(b"warc-payload-digest", b"")
    kind = headers[b"warc-type"]
    if headers.get(b"warc-block-digest", b"") != b"sha1:" + base32_sha1(block).encode():
        raise ArchiveError("block digest")
    if kind == b"response":
        if payload_bytes != len(payload) or digest != b"sha1:" + base32_sha1(payload).encode():
            raise ArchiveError("payload length or digest")
    elif kind != b"revisit" or payload or payload_bytes < 0 or headers.get(b"warc-profile") != REVISIT_PROFILE:
        raise ArchiveError(f"record of type {kind!r}")
    refers = headers.get(b"warc-refers-to")
    return {
        "record_id": row_of(headers[b"warc-record-id"]),
        "target": headers.get(b"warc-target-uri", b"").decode(),
        "record_type": kind.decode(),
        "refers_to": row_of(refers) if refers is not None else None,
        "payload_bytes": payload_bytes,
        "payload_digest": digest.removeprefix(b"sha1:").decode(),
        "payload": payload if kind == b"response" else None,
    }


# Files


def open_file(path: str, mode: str):
    """A stream of a local path or of any URI that Arrow's file systems know."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))
    if mode == "r":
        return store.open_input_stream(inner)
    store.create_dir(os.path.dirname(inner), recursive=True)
    return store.open_output_stream(inner)


def write_archive(stream, records: Iterator[bytes], samples: list[bytes]) -> int:
    """Dictionary frame and a frame per record; without enough samples the dictionary is the samples' raw bytes."""
    import zstandard as zstd

    try:
        dictionary = zstd.train_dictionary(DICTIONARY_BYTES, samples, k=200, d=8)
    except zstd.ZstdError:
        dictionary = zstd.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    body = zstd.ZstdCompressor(level=3).compress(dictionary.as_bytes())
    stream.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)
    compressor = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    written = 0
    for record in records:
        stream.write(compressor.compress(record))
        written += 1
    return written


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[dict]:
    """Validated records of one archive, one frame in memory at a time."""
    import zstandard as zstd

    start = stream.read(8)
    if len(start) < 8 or struct.unpack("<I", start[:4])[0] != DICTIONARY_MAGIC:
        raise ArchiveError("no leading dictionary frame")
    size = struct.unpack("<I", start[4:])[0]
    body = stream.read(size)
    if len(body) != size:
        raise ArchiveError("the dictionary frame is cut short")
    if body[:4] == struct.pack("<I", FRAME_MAGIC):
        body = zstd.ZstdDecompressor().decompress(body)
    decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(body))
    held = b""
    while True:
        frame, out = decompressor.decompressobj(), io.BytesIO()
        while not frame.eof:
            held = held or stream.read(chunk)
            if not held:
                if out.tell() or frame.unused_data:
                    raise ArchiveError("a frame is cut short")
                return
            out.write(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
            if not held and not frame.eof:
                held = stream.read(chunk)
                if not held:
                    raise ArchiveError("a frame is cut short")
        yield parse_record(out.getvalue())


# Tables


def mark_revisits(rows: DataFrame, record_id: str, payload: str, min_bytes: int) -> DataFrame:
    """``record_id, target columns, payload, refers_to, is_revisit``: who refers to whom.

    Only the smallest id of payloads that occur with several ids is joined back; ids are aggregated before they
    are shuffled, so one common payload is no large group.
    """
    keyed = rows.withColumn("_key", F.when(F.length(payload) >= min_bytes, F.sha1(payload)))
    several = (F.col("_first") < F.col("_last")) | (F.col("_null") & F.col("_first").isNotNull())
    first = (
        keyed.where("_key IS NOT NULL")
        .groupBy("_key")
        .agg(
            F.min(record_id).alias("_first"),
            F.max(record_id).alias("_last"),
            F.max(F.col(record_id).isNull()).alias("_null"),
        )
        .where(several)
        .select("_key", "_first")
    )
    revisit = F.col("_first").isNotNull() & ~F.col(record_id).eqNullSafe(F.col("_first"))
    return keyed.join(first, "_key", "left").withColumns(
        {"is_revisit": revisit, "refers_to": F.when(revisit, F.col("_first"))}
    )


def write_archives(pages: DataFrame, record_id: str, target: str, text: str, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record per row; returns the written list of archives (``path, records``)."""
    spark = pages.sparkSession
    folder = (folder or shared_folder(spark)).rstrip("/") + "/warc-" + uuid.uuid4().hex
    rows = pages.select(
        F.col(record_id).cast("long").alias("record_id"),
        F.col(target).cast("string").alias("target"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = mark_revisits(rows, "record_id", "payload", min_bytes)
    rows = rows.select("record_id", "target", "payload", "refers_to", "is_revisit")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, counts, held, size = [], [], [], 0

        def flush() -> None:
            samples, taken = [], 0
            for record in held:
                if taken >= SAMPLE_BYTES:
                    break
                samples.append(record)
                taken += len(record)
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"  # an attempt's own name
            with open_file(path, "w") as stream:
                counts.append(write_archive(stream, iter(held), samples))
            paths.append(path)

        for batch in batches:
            for row in zip(*(c for c in batch.columns)):
                record = record_bytes(*(x.as_py() for x in row))
                held.append(record)
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "records"])

    return materialize(rows.mapInArrow(archives, MANIFEST), "archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """Validated records of the listed archives; the number of records must match the list."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.int64()), ("target", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
             ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
        )
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, size, seen = [], 0, 0
                with open_file(path, "r") as stream:
                    for record in read_archive(stream):
                        held.append(record)
                        seen += 1
                        size += record["payload_bytes"]
                        if size >= 8 << 20 or len(held) >= 5_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                if seen != expected:
                    raise ArchiveError(f"{path}: {seen} records, {expected} were written")
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    tasks = archives.sparkSession.sparkContext.defaultParallelism
    return archives.repartition(max(tasks, 1)).mapInArrow(records, RECORDS)
