"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, followed by a seek table in a
skippable frame (frame count, compressed and decompressed size of each frame, a fixed magic number).  The manifest
maps record ids to bundle, frame and offset inside the frame.  Bundles are written by the executors into a folder
that all of them share; a bundle counts only once its manifest rows have been committed, so retried or
speculative tasks leave at most unreferenced files behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_few, materialize, scratch_path

# Fixed values of the seekable Zstandard format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

RECORDS = "page_id long, url string, payload binary, sha1 string, refers_to long, refers_to_url string, record_type string"
MANIFEST = "bundle string, record string, page_id long, frame int, offset long, length long"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"

#: Repeated payloads whose table is sent to every task; beyond that many, rows are shuffled.
BROADCAST_ROWS = 200_000


class Damaged(ValueError):
    """An archive that does not hold what was written."""


def record_id(page_id: int | None, sha1: str, ordinal: int) -> str:
    """``ordinal`` is the record's place in its write, as page ids may be null or repeated."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}:{ordinal}')}>"


def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def to_record(record: str, date: str, page_id, url, payload: bytes | None, sha1: str, refers_to, refers_to_url, record_type: str) -> bytes:
    """One WARC/1.1 record over an HTTP message; a revisit has the message's head only."""
    body = payload or b"" if record_type == "response" else b""
    http = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8"]
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_digest(bytes.fromhex(sha1))}"]
    if url is not None:
        head.append("WARC-Target-URI: " + _uri(url))
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To-Date: {date}")
        if refers_to_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + _uri(refers_to_url))
        head.append(f"X-Refers-To-Page: {refers_to}")
    else:
        http.append(f"Content-Length: {len(body)}")
    block = "\r\n".join(http).encode() + b"\r\n\r\n" + body
    head += [f"X-Page: {'' if page_id is None else page_id}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_record(data: bytes) -> dict:
    """The fields of READ from one record.  Length and digest of a response are those of the payload that is there;
    raises :class:`Damaged` if they are not those that were written.  A revisit has no payload and no length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise Damaged("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    try:
        kind, size, written = fields["WARC-Type"], int(fields["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page_id = int(fields["X-Page"]) if fields["X-Page"] else None
        refers_to = int(fields["X-Refers-To-Page"]) if kind == "revisit" else None
    except (KeyError, ValueError) as e:
        raise Damaged(f"record head: {e}") from e
    block = rest[:size]
    if len(block) < size or rest[size:] != b"\r\n\r\n":
        raise Damaged("record is cut short")
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and (digest := base32_digest(hashlib.sha1(payload).digest())) != written:
        raise Damaged(f"{fields.get('WARC-Record-ID')}: payload has digest {digest}, {written} was written")
    return {
        "page_id": page_id,
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": None if payload is None else len(payload),
        "payload_digest": written,
        "refers_to": refers_to,
        "payload": payload,
    }


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, full) for packed, full in sizes)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)


class SeekableReader:
    """Random access to the frames of a bundle through its footer; reads no frame that isn't asked for."""

    def __init__(self, source) -> None:
        self._file = source
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", source.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        table = source.read_at(count * width, size - 9 - count * width)
        self.frames, at = [], 0
        for i in range(count):
            packed, full = struct.unpack_from("<II", table, i * width)
            self.frames.append((at, packed, full))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, full = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self._file.read_at(packed, at), max_output_size=full)


def _open(uri: str):
    """Arrow's file system and path for a folder: local, HDFS and object stores, as far as Arrow is built with them."""
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if uri.startswith("s3a://") else uri)


def _write_kernel(folder: str, date: str, frame_bytes: int, bundle_bytes: int, level: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _open(folder)
        packer = zstandard.ZstdCompressor(level=level)
        out, name, at = None, "", 0
        sizes: list[tuple[int, int]] = []
        waiting: list[tuple[bytes, str, int | None]] = []
        held, ordinal = 0, TaskContext.get().partitionId() << 40
        index: list[tuple] = []

        def close_frame() -> None:
            nonlocal held, at, out, name
            if not waiting:
                return
            if out is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                out = where.open_output_stream(f"{top}/{name}", compression=None)
            offset = 0
            for data, record, page_id in waiting:
                index.append((name, record, page_id, len(sizes), offset, len(data)))
                offset += len(data)
            packed = packer.compress(b"".join(x for x, _, _ in waiting))
            out.write(packed)
            sizes.append((len(packed), offset))
            at += len(packed)
            waiting.clear()
            held = 0

        def close_bundle() -> Iterator[pa.RecordBatch]:
            nonlocal out, at
            close_frame()
            if out is not None:
                out.write(seek_table(sizes))
                out.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*index, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                    ["bundle", "record", "page_id", "frame", "offset", "length"],
                )
            out, at = None, 0
            sizes.clear()
            index.clear()

        for batch in batches:
            for row in zip(*(c for c in batch.columns), strict=True):
                page_id, url, payload, sha1, refers_to, refers_to_url, kind = (x.as_py() for x in row)
                record, ordinal = record_id(page_id, sha1, ordinal), ordinal + 1
                data = to_record(record, date, page_id, url, payload, sha1, refers_to, refers_to_url, kind)
                if waiting and held + len(data) > frame_bytes:
                    close_frame()
                    if at >= bundle_bytes:
                        yield from close_bundle()
                waiting.append((data, record, page_id))
                held += len(data)
        yield from close_bundle()

    return kernel


def write_bundles(records: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3, date: str | None = None) -> DataFrame:
    """Write RECORDS rows as bundles under ``folder`` (a URI that all executors reach) and return the committed
    MANIFEST.  Frames close at ``frame_bytes`` of records (a larger record has a frame of its own), bundles at
    ``bundle_bytes``.  ``date`` is the records' WARC-Date, now by default.  Record ids are unique in a write, whatever
    the page ids."""
    where, top = _open(folder)
    where.create_dir(top, recursive=True)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    return materialize(records.mapInArrow(_write_kernel(folder, date, frame_bytes, bundle_bytes, level), MANIFEST), "manifest")


def _read_kernel(folder: str, with_payload: bool):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, top = _open(folder)
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
        )
        now, source, reader = None, None, None
        for batch in batches:
            for name, frame, offsets, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != now:  # rows are sorted by bundle: its seek table is read once
                    if source is not None:
                        source.close()
                    source = where.open_input_file(f"{top}/{name}")
                    now, reader = name, SeekableReader(source)
                try:
                    data = reader.frame(frame)
                except zstandard.ZstdError as e:
                    raise Damaged(f"{name}, frame {frame}: {e}") from e
                rows = [from_record(data[o : o + n]) for o, n in zip(offsets, lengths, strict=True)]
                if not with_payload:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema)
        if source is not None:
            source.close()

    return kernel


def read_bundles(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Read the records that ``manifest`` lists (all of it, or any rows of it) as READ rows; each frame that holds
    one is fetched once through its bundle's seek table.  Payloads are checked against their digests."""
    frames = manifest.groupBy("bundle", "frame").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("at"))
    frames = frames.select("bundle", "frame", F.col("at.offset").alias("offsets"), F.col("at.length").alias("lengths"))
    size = manifest.agg(F.sum("length")).first()[0] or 0
    tasks = max(3 * manifest.sparkSession.sparkContext.defaultParallelism, size >> 28)
    frames = frames.repartitionByRange(tasks, "bundle", "frame").sortWithinPartitions("bundle", "frame")
    return frames.mapInArrow(_read_kernel(folder, with_payload), READ)


def with_revisits(pages: DataFrame, payload: Column, min_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """RECORDS rows of ``pages`` (page_id, url): among equal payloads of at least ``min_bytes`` the rows with the
    smallest page_id are responses and the others revisit it, without their payload; smaller payloads are all responses.

    Only digests that occur more than once are looked up, in a broadcast table as long as they are ``broadcast_rows`` at
    most, so that no payload is shuffled.
    """
    data = F.coalesce(payload.cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), data.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    known = rows.where((F.length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    first = known.groupBy("sha1").agg(F.min(F.struct("page_id", "url")).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    first = materialize(first.select("sha1", F.col("_first.page_id").alias("first_id"), F.col("_first.url").alias("first_url")), "repeated")
    again = F.coalesce((F.col("page_id") > F.col("first_id")) & (F.length("payload") >= min_bytes), F.lit(False))
    return join_few(rows, first, ["sha1"], F.col("page_id"), broadcast_rows).select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha1",
        F.when(again, F.col("first_id")).alias("refers_to"),
        F.when(again, F.col("first_url")).alias("refers_to_url"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
    )


def with_referred(read: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """READ rows, the length of each revisit's payload taken from the response that it refers to; fails if the archive
    holds none of that page and digest."""
    asked = read.where("record_type = 'revisit'").select("payload_digest").distinct()
    sizes = read.where("record_type = 'response'").select("payload_digest", "page_id", "payload_bytes").join(asked, "payload_digest", "left_semi")
    sizes = sizes.groupBy("payload_digest").agg(F.min("page_id").alias("_page"), F.max("payload_bytes").alias("_bytes"))
    met = join_few(read, materialize(sizes, "sizes"), ["payload_digest"], F.col("page_id"), broadcast_rows)
    fits = F.coalesce(F.col("_page") == F.col("refers_to"), F.lit(False))
    missing = F.raise_error(F.concat(F.lit("revisit without its response: page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long")
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).when(fits, F.col("_bytes")).otherwise(missing)
    return met.withColumn("payload_bytes", size).select(*read.columns)


def archive(pages: DataFrame, payload: str = "html", min_bytes: int = 0, with_payload: bool = False, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write ``pages`` (page_id, url and the payload column; others are ignored) to bundles and read all of them back.

    A null payload is empty; a null page_id is archived as a response of its own; rows that repeat the smallest
    page_id of a payload are each a response; an empty table writes no bundle and gives no rows.  Lengths and digests
    are those of the payloads read; a damaged archive raises an error.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    manifest = write_bundles(with_revisits(pages, F.col(payload), min_bytes, broadcast_rows), folder)
    read = read_bundles(manifest, folder, with_payload)
    return with_referred(materialize(read, "read"), broadcast_rows)
