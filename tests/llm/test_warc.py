import base64
import hashlib
import struct

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from strandwise.llm import warc

SCHEMA = "page_id long, url string, html string, sha1 string, payload int, refers_to string"


def brute(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and i > first[h or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if again else "response", first[h or ""] if again else None))
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (4, "u\r\nX-Page: 77", "é\r\n\r\nWARC/1.1\r\n"),
    (6, "c", None), (7, "c", ""), (None, "n", "<p>same</p>"), (3, "http://b/", "<p>same</p>"), (8, "long", "ab" * 2_000_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], SCHEMA)


@pytest.mark.parametrize("bound", [warc.BROADCAST_ROWS, 0])
@pytest.mark.parametrize("rows", [ROWS, []])
def test_round_trip(spark, rows, bound):
    got = warc.archive(frame(spark, rows), with_payload=True, broadcast_rows=bound).collect()
    digest = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str)
    assert digest == brute(rows)
    texts = {i: h or "" for i, _, h in rows}
    for r in got:
        if r.record_type == "response" and r.page_id is not None:
            assert bytes(r.payload).decode() == texts[r.page_id]


def test_small_payloads_are_all_responses(spark):
    got = warc.archive(frame(spark, [(1, "a", "x"), (2, "b", "x"), (3, "c", "xyz"), (4, "d", "xyz")]), min_bytes=2).collect()
    assert {r.page_id: r.record_type for r in got} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_frames_are_independent_and_the_seek_table_is_standard(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"page {i} " * 50) for i in range(200)]
    folder = f"file://{tmp_path}/bundles"
    records = warc.with_revisits(frame(spark, rows), F.col("html"))
    manifest = warc.write_bundles(records, folder, frame_bytes=4096, bundle_bytes=8192).collect()
    assert len(manifest) == 200 and len({m.bundle for m in manifest}) > 1
    where, top = fs.FileSystem.from_uri(folder)
    for name in {m.bundle for m in manifest}:
        data = where.open_input_file(f"{top}/{name}").read()
        count, _, magic = struct.unpack("<IBI", data[-9:])
        assert magic == 0x8F92EAB1
        size = struct.unpack("<I", data[-9 - 8 * count - 4 : -9 - 8 * count])[0]
        assert size == 8 * count + 9
        whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        reader = warc.SeekableReader(where.open_input_file(f"{top}/{name}"))
        assert b"".join(reader.frame(k) for k in reversed(range(count)))[:0] == b""
        assert b"".join(reader.frame(k) for k in range(count)) == whole
    picked = [m for m in manifest if m.page_id == 123]
    got = warc.read_bundles(spark.createDataFrame(picked, warc.MANIFEST), folder).collect()
    assert [bytes(r.payload).decode() for r in got] == ["page 123 " * 50]


def test_record_ids_are_unique(spark, tmp_path):
    rows = [(None, "u", "a"), (None, "u", "a"), (1, "u", "a"), (1, "u", "a"), (2, "v", "a"), (3, None, None)]
    manifest = warc.write_bundles(warc.with_revisits(frame(spark, rows), F.col("html")), f"file://{tmp_path}/b").collect()
    assert len({m.record for m in manifest}) == len(rows)


def record(kind="response", payload=b"abc"):
    return warc.to_record("<urn:uuid:1>", "2024-01-01T00:00:00Z", 1, "u", payload, hashlib.sha1(b"abc").hexdigest(), 7 if kind == "revisit" else None, "v", kind)


def test_records_have_what_the_format_requires():
    for kind in ("response", "revisit"):
        head = record(kind).split(b"\r\n\r\n")[0].decode().split("\r\n")
        names = {x.split(": ")[0] for x in head[1:]}
        assert head[0] == "WARC/1.1" and names >= {"WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length", "Content-Type", "WARC-Target-URI"}
    assert {"WARC-Profile", "WARC-Refers-To-Target-URI", "WARC-Refers-To-Date"} <= names


def test_damage_is_noticed():
    assert warc.from_record(record())["payload"] == b"abc"
    assert warc.from_record(record("revisit"))["refers_to"] == 7
    whole = record()
    broken = [whole[:-1], whole.replace(b"abc", b"abd"), whole.replace(b"WARC/1.1", b"WARC/1.x"), whole.replace(b"X-Page: 1", b"X-Page: x"), whole.replace(b"sha1:", b"sha1:A")]
    for data in broken:
        with pytest.raises(warc.Damaged):
            warc.from_record(data)


def test_a_flipped_byte_in_a_bundle_is_reported(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    manifest = warc.write_bundles(warc.with_revisits(frame(spark, [(i, "u", f"page {i} " * 400) for i in range(8)]), F.col("html")), folder)
    where, top = fs.FileSystem.from_uri(folder)
    for name in {m.bundle for m in manifest.collect()}:
        with where.open_input_file(f"{top}/{name}") as source:
            reader = warc.SeekableReader(source)
            frames = [reader.frame(k).replace(b"page 5", b"page 6", 1) for k in range(len(reader.frames))]
        packed = [zstandard.compress(f) for f in frames]
        (tmp_path / "b" / name).write_bytes(b"".join(packed) + warc.seek_table([(len(p), len(f)) for p, f in zip(packed, frames)]))
    with pytest.raises(Exception, match="Damaged"):
        warc.read_bundles(manifest, folder).collect()


def test_a_revisit_without_its_response_is_reported(spark, tmp_path):
    folder = f"file://{tmp_path}/b"
    manifest = warc.write_bundles(warc.with_revisits(frame(spark, [(1, "u", "same"), (2, "v", "same"), (3, "w", "other")]), F.col("html")), folder)
    whole = warc.with_referred(warc.read_bundles(manifest, folder)).collect()
    assert {r.page_id: r.payload_bytes for r in whole} == {1: 4, 2: 4, 3: 5}
    with pytest.raises(Exception, match="without its response"):
        warc.with_referred(warc.read_bundles(manifest.where("page_id > 1"), folder)).collect()
