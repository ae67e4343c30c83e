from __future__ import annotations

import base64
import hashlib

import pytest

from sylva.llm import common, warc


def brute(rows):
    first: dict = {}
    for page, html in rows:
        old = first.get(html or "")
        first[html or ""] = page if old is None or (page is not None and page < old) else old
    out = []
    for page, html in rows:
        raw = (html or "").encode()
        origin = first[html or ""]
        response = origin is None or origin == page
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else origin))
    return sorted(out, key=str)


def read(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = common.new_path(spark, "w")
    warc.write(spark, df, folder)
    return sorted((tuple(r) for r in warc.read_pages(spark, folder).collect()), key=str)


def test_round_trip_of_odd_pages(spark):
    long = "é<p>line\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a", "x"), (2, "http://b\nc", "x"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", long), (7, "u", "\r\n\r\n"), (None, "u", "x"), (None, None, "alone"), (8, "u", "twice"), (8, "u", "twice"), (8, "u", "other"), (9, "u", "0\r\n\r\n" * 5000)]
    assert read(spark, rows) == brute([(p, h) for p, _, h in rows])
    assert read(spark, []) == []


def test_pages_table(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in warc.op9_warc(spark, sf).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("size", [1, 3, 10, 4096])
def test_framing_and_segments(size):
    payload = ("né€😀x" * 50).encode()
    assert warc.unframed(warc.framed(payload, size)) == payload
    assert warc.unframed(b"5;ext=1\r\nhello\r\n0\r\nTrailer: x\r\n\r\n") == b"hello"
    with pytest.raises(ValueError):
        warc.unframed(warc.framed(payload, 64)[:100])
    parts = [r for raw in warc.segments("urn:page:1:d", [], payload, max(size, 16)) for r in warc.records(raw + b"\r\n\r\n")]
    assert b"".join(block for _, block in parts) == payload
    if len(parts) > 1:
        assert [f["warc-segment-number"] for f, _ in parts] == [str(k) for k in range(1, len(parts) + 1)] and parts[-1][0]["warc-segment-total-length"] == str(len(payload))


def test_missing_segments_are_errors(spark, tmp_path):
    payload = "x" * 50_000
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload.encode()
    fields = [("WARC-Payload-Digest", f"sha1:{warc.digest(payload.encode())}")]
    parts = warc.segments("urn:page:1:d", fields, block, 16_384)
    (tmp_path / "part-0").write_bytes(b"\r\n\r\n".join(parts[:1] + parts[2:]) + b"\r\n\r\n")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassembled(spark, f"file://{tmp_path}").collect()
    (tmp_path / "part-0").write_bytes(b"\r\n\r\n".join(reversed(parts)) + b"\r\n\r\n")
    (row,) = warc.reassembled(spark, f"file://{tmp_path}").collect()
    assert row.page_id == 1 and bytes(row.payload) == payload.encode()
