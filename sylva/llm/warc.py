"""WARC archives: writing, reading back, and segment reassembly.

A page becomes one logical record: a ``response`` with an HTTP head and chunked transfer framing, cut into a first segment
and continuation records where it is long, or a ``revisit`` of the equal payload with the smallest page_id. Spark's text
writer puts the records out with the blank lines between records as its line separator, so the files are WARC/1.1, gzipped.
Archives are read whole, each bounded in size; records are cut by Content-Length; continuations are grouped by origin
identifier, ordered by segment number and held against the total length before the transfer framing is decoded.

Defined cases: a null html is an empty payload; a null page_id is written as the empty id and read back as null; rows that
repeat an id and payload are records of their own, responses where that id is the smallest of its payload; an empty table
makes an archive without records; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

#: Payloads from this size on are written once; a block longer than SEGMENT bytes is continued in further records.
SMALLEST_REVISITED, SEGMENT, FRAME = 0, 16_384, 4_096
#: Bytes of html in an archive file, about; and records in it at most.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 24 << 20, 40_000

_END = b"\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def cuts(data: bytes, size: int) -> list[int]:
    """0, then places about ``size`` bytes apart that split no UTF-8 character, then the length."""
    out, at = [0], 0
    while len(data) - at > size:
        at += size
        while at < len(data) and data[at] & 0xC0 == 0x80:
            at += 1
        out.append(at)
    return out if out[-1] == len(data) and data else [*out, len(data)]


def framed(payload: bytes, frame: int) -> bytes:
    """Chunked transfer framing."""
    ends = cuts(payload, frame) if payload else [0]
    parts = [payload[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unframed(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are passed over. Raises where the body is cut short."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        if not size:
            return b"".join(out)
        if len(body) < end + 2 + size + 2:
            raise ValueError("a chunk is cut short")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def segments(identifier: str, fields: list[tuple[str, str]], block: bytes, size: int) -> list[bytes]:
    """A response record, cut where a UTF-8 character ends into a first segment and continuations."""
    if len(block) <= size:
        return [record("response", [("WARC-Record-ID", f"<{identifier}>"), *fields], block)]
    ends = cuts(block, size)
    out = []
    for n, (a, b) in enumerate(zip(ends, ends[1:], strict=False), 1):
        number = ("WARC-Segment-Number", str(n))
        if n == 1:
            out.append(record("response", [("WARC-Record-ID", f"<{identifier}>"), *fields, number], block[a:b]))
            continue
        last = [("WARC-Segment-Total-Length", str(len(block)))] if b == len(block) else []
        out.append(record("continuation", [("WARC-Record-ID", f"<{identifier}:{n}>"), ("WARC-Segment-Origin-ID", f"<{identifier}>"), number, *last], block[a:b]))
    return out


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of an archive."""
    at = 0
    while at < len(data):
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(_END, at)
        fields = {}
        for line in data[at:end].split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            fields[name.decode().strip().lower()] = value.decode().strip()
        size = int(fields["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError("an archive is cut short")
        yield fields, block
        at = end + 4 + size


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, without transfer framing."""
    head, _, body = block.partition(_END)
    chunked = any(x.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for x in head.split(b"\r\n"))
    return unframed(body) if chunked else body


def _urn(page_id: int | None, of: str) -> str:
    """A record's identifier: two payloads under one page_id are two records."""
    return f"urn:page:{'' if page_id is None else page_id}:{of}"


def _page_of(identifier: str) -> int | None:
    page = identifier.strip("<>").split(":")[2]
    return int(page) if page else None


def write(spark: SparkSession, pages: DataFrame, folder: str, smallest: int = SMALLEST_REVISITED, segment: int = SEGMENT) -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``folder``."""
    common.small_batches(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("sha1"), F.octet_length(html).alias("n"))
    digests = common.stage(spark, rows.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"), F.max("n").alias("n")), "digests")
    first = digests.filter((F.col("rows") > 1) & (F.col("n") >= smallest)).select("sha1", "first")
    few = first.count() <= 200_000  # 10 MB of repeated digests are broadcast at most; beyond, pages are shuffled
    facts = digests.agg(F.sum(F.col("n") * F.col("rows")).alias("bytes"), F.sum("rows").alias("rows")).first()
    records_a_file = max(1, min(ARCHIVE_RECORDS, int(ARCHIVE_BYTES * (facts.rows or 0) // max(1, facts.bytes or 0))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, texts, firsts in common.column_lists(batches):
            out = []
            for page, url, text, first in zip(ids, urls, texts, firsts, strict=True):
                payload = text.encode()
                sha1 = digest(payload)
                named = [("WARC-Target-URI", " ".join((url or "").split())), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response")]
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                if first is not None and first != page:
                    to = ("WARC-Refers-To", f"<{_urn(first, sha1)}>")
                    profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
                    out.append(record("revisit", [("WARC-Record-ID", f"<{_urn(page, sha1)}:revisit>"), *named, to, profile], head + b"\r\n").decode())
                    continue
                block = head + b"Transfer-Encoding: chunked\r\n\r\n" + framed(payload, FRAME)
                out += [x.decode() for x in segments(_urn(page, sha1), named, block, segment)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # pages are written where they are read; an archive ends after as many records as make up its size on average
    joined = rows.join(F.broadcast(first) if few else first, "sha1", "left").select("page_id", "url", "html", "first")
    joined.mapInArrow(run, "value string").write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives: identifier, kind, origin, number, total, refers_to, declared digest, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (files,) in common.column_lists(batches):
            for data in files:
                rows, held = [], 0
                for f, block in records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    name = f["warc-record-id"].strip("<>")
                    origin = f.get("warc-segment-origin-id", f["warc-record-id"]).strip("<>")
                    rows.append((name, f["warc-type"], origin, int(f.get("warc-segment-number", 1)), int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None, "warc-segment-number" in f, f.get("warc-refers-to"), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _segment_batch(rows)
                        rows, held = [], 0
                yield _segment_batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(run, _SEGMENTS)


_SEGMENTS = "name string, kind string, origin string, number int, total long, cut boolean, refers string, declared string, block binary"


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.binary()]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _SEGMENTS.split(", ")])


def reassembled(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, record_type, refers_to, declared, payload (null for revisits): whole records again.

    Records of one segment need no grouping; the others meet by origin. Copies of a record give as many whole ones.
    """
    all_ = read_segments(spark, folder)
    single = all_.filter("NOT cut").select("name", "kind", "refers", "declared", F.array(F.struct("number", "total", "block")).alias("parts"))
    cut = all_.filter("cut").groupBy("origin").agg(F.max(F.when(F.col("kind") != "continuation", F.col("kind"))).alias("kind"), F.max("declared").alias("declared"), F.sort_array(F.collect_list(F.struct("number", "total", "block"))).alias("parts"))
    whole = single.unionByName(cut.select(F.col("origin").alias("name"), "kind", F.lit(None).cast("string").alias("refers"), "declared", "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, kinds, refers, declared, lists in common.column_lists(batches):
            out = []
            for name, kind, to, said, parts in zip(names, kinds, refers, declared, lists, strict=True):
                if kind == "revisit":
                    out.append((_page_of(name), kind, _page_of(to), said, None))
                    continue
                copies = sum(p["number"] == 1 for p in parts)
                if not copies or len(parts) % copies:
                    raise ValueError(f"{name}: segments are missing")
                line = parts[::copies]
                if [p["number"] for p in line] != list(range(1, len(line) + 1)):
                    raise ValueError(f"{name}: segments are missing")
                block = b"".join(p["block"] for p in line)
                if len(line) > 1 and line[-1]["total"] != len(block):
                    raise ValueError(f"{name}: {len(block)} bytes of {line[-1]['total']}")
                payload = payload_of(block)
                if digest(payload) != said:
                    raise ValueError(f"{name}: the payload differs from its digest")
                out += [(_page_of(name), kind, None, said, payload)] * copies
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds_ = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds_, strict=True)], names=["page_id", "record_type", "refers_to", "declared", "payload"])

    return whole.mapInArrow(run, "page_id long, record_type string, refers_to long, declared string, payload binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_path(spark, "warc")
    write(spark, common.table(spark, sf_dir, "pages"), folder)
    return read_pages(spark, folder)


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Per page: payload_bytes and payload_digest of the full payload, record_type, refers_to; revisits look at their response."""
    slim = common.stage(spark, reassembled(spark, folder).select("page_id", "record_type", "refers_to", F.col("declared").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    responses = slim.filter("record_type = 'response'")
    known = responses.groupBy(F.col("page_id").alias("to"), F.col("payload_digest").alias("d")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = slim.filter("record_type = 'revisit'").drop("payload_bytes").join(known, (F.col("refers_to") == F.col("to")) & (F.col("payload_digest") == F.col("d")), "left")
    missing = F.raise_error(F.concat(F.lit("page "), F.col("page_id"), F.lit(": the response it refers to is missing"))).cast("long")
    revisits = revisits.withColumn("payload_bytes", F.when(F.col("payload_bytes").isNull(), missing).otherwise(F.col("payload_bytes")))
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*out).unionByName(revisits.select(*out))
