"""WARC archives: writing, reading, and reassembly of segmented records.

Writing: one record a page with a chunked HTTP response. Pages whose payload
(of at least ``min_revisit_bytes``) equals that of a page with a smaller id
become revisit records. Blocks longer than ``segment_bytes`` are cut into a
first segment and continuation records, each a record of its own. Archives go to a
shared folder in files of at most ``records_per_file`` records and ``file_bytes`` bytes
before compression, as no record's block is longer than a segment: a file is one
task's input, so it must not outgrow its memory.

Reading: each file is decompressed and parsed as a stream by ``Content-Length``.
Records that are whole are decoded at once. Segments are grouped by origin id,
ordered by number, and checked against the total length; then the chunked
framing is taken off and the payload held against its stated digest. A group is one
record, so it has that record's size.

Defined cases: of pages with equal payloads and the same smallest id all are responses;
payloads longer than a segment are cut and put together again, whatever their length; an
empty table gives no archives; null html is an empty payload; a null page id never is the
response of others; repeated page ids are kept row by row; records with missing,
repeated or wrong segments get status ``incomplete``, bad chunk framing status
``malformed``, payloads that don't fit their stated SHA-256 status ``digest``, all with a
null payload. Extra columns of ``pages`` are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.session import fresh_path, stored, table

from .common import arrow_map, map_batches, salted_left_join

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"

#: More than a record's header has, but for its URI.
HEAD_BYTES = 1_024

RECORD = T.StructType([
    T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to_id", T.StringType()),
    T.StructField("stated_digest", T.StringType()),
    T.StructField("stated_bytes", T.LongType()),
    T.StructField("origin_id", T.StringType()),
    T.StructField("segment_number", T.LongType()),
    T.StructField("total_length", T.LongType()),
    T.StructField("block", T.BinaryType()),
])


def chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked transfer coding; chunks end between characters."""
    out, at = [], 0
    while at < len(payload):
        end = _boundary(payload, at, chunk_bytes)
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def _boundary(b: bytes, at: int, size: int) -> int:
    end = min(len(b), at + size)
    while at < end < len(b) and b[end] & 0xC0 == 0x80:
        end -= 1
    return end if end > at else min(len(b), at + size)


def dechunked(body: bytes) -> bytes | None:
    """The payload, or None where the framing is broken. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        if n == 0:
            return b"".join(out)
        at = end + 2
        if n < 0 or body[at + n:at + n + 2] != b"\r\n":
            return None
        out.append(body[at:at + n])
        at += n + 2


def payload_of(block: bytes | None) -> bytes | None:
    """The payload of an HTTP response block, by its transfer coding or content length."""
    head, sep, body = (block or b"").partition(b"\r\n\r\n")
    if not sep:
        return None
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")):
        return dechunked(body)
    if m := re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head.replace(b"\r\n", b"\n")):
        return body[:int(m[1])] if len(body) >= int(m[1]) else None
    return body


def records_of(page_id, url, html, digest, response_id, segment_bytes: int, chunk_bytes: int, date: str) -> list[str]:
    """The record of one page as text, in segments where it is long; the last blank lines are the writer's."""
    revisit = response_id is not None and response_id != page_id
    payload = (html or "").encode()
    block = HTTP_HEAD.encode() + (b"" if revisit else chunked(payload, chunk_bytes))
    name = "" if page_id is None else page_id
    own = f"<urn:x-page:{name}:{uuid.uuid4()}>"
    common = [f"WARC-Date: {date}", *([] if url is None else ["WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)])]
    cuts, at = [], 0
    while at < len(block):
        end = _boundary(block, at, segment_bytes)
        cuts.append(block[at:end])
        at = end
    out = []
    for k, part in enumerate(cuts, 1):
        head = [VERSION, f"WARC-Type: {'continuation' if k > 1 else 'revisit' if revisit else 'response'}"]
        head += [f"WARC-Record-ID: {own if k == 1 else f'<urn:uuid:{uuid.uuid4()}>'}", *common]
        if k == 1:
            head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
        if revisit:  # the length is an extension field: a revisit has no payload of its own to measure
            head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{response_id}>", f"X-Payload-Length: {len(payload)}"]
        if len(cuts) > 1:
            head += [f"WARC-Segment-Number: {k}", *([f"WARC-Segment-Origin-ID: {own}"] if k > 1 else [])]
            head += [f"WARC-Segment-Total-Length: {len(block)}"] if k == len(cuts) else []
        out.append(CRLF.join([*head, f"Content-Length: {len(part)}", "", ""]) + part.decode())
    return out


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 100, segment_bytes: int = 65_536, chunk_bytes: int = 8_192, records_per_file: int = 4_000, file_bytes: int = 256_000_000, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write the archives of ``pages`` (``page_id, url, html``) and return their folder."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"))
    p = p.withColumn("twin", F.when(F.octet_length(html) >= min_revisit_bytes, F.col("digest")))
    first = p.where("twin IS NOT NULL").groupBy("twin").agg(F.min("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    held = salted_left_join(p, stored(first, "twins"), ["twin"], ["page_id"])
    schema = T.StructType([T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "html", "digest", "response_id")]
            rows = [r for page in zip(*cols, strict=True) for r in records_of(*page, segment_bytes, chunk_bytes, date)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.string())], names=["value"])

    arrow_map(held, run, schema).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", max(1, min(records_per_file, file_bytes // (segment_bytes + HEAD_BYTES)))).text(path)
    return path


def stream(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, compressed as one or many gzip members or not at all."""
    view, buf = memoryview(content), bytearray()
    packed = content[:2] == b"\x1f\x8b"
    at, z = 0, zlib.decompressobj(31)

    def more() -> bool:
        nonlocal at, z
        while at < len(view):
            piece = bytes(view[at:at + 1_048_576])
            at += len(piece)
            if packed:
                got = z.decompress(piece)
                while z.eof and z.unused_data:
                    rest, z = z.unused_data, zlib.decompressobj(31)
                    got += z.decompress(rest)
                if z.eof:
                    z = zlib.decompressobj(31)
                piece = got
            if piece:
                buf.extend(piece)
                return True
        return False

    while True:
        while (end := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                return
        head = {}
        for line in bytes(buf[:end]).decode("utf-8", "replace").strip().split(CRLF)[1:]:
            k, _, v = line.partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head.get("content-length", 0))
        while len(buf) < end + 4 + n:
            if not more():
                return
        yield head, bytes(buf[end + 4:end + 4 + n])
        del buf[:end + 4 + n]
        while len(buf) < 4 and more():
            pass
        if buf[:4] == b"\r\n\r\n":
            del buf[:4]


def read(spark: SparkSession, path: str, segments: bool) -> DataFrame:
    """The records of all archives in a folder that are segments, or those that aren't."""
    arrow = to_arrow_schema(RECORD)

    def long(v: str | None) -> int | None:
        return int(v) if v and v.isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for content in b.column(0):
                for h, block in stream(content.as_py()):
                    if ("warc-segment-number" in h) != segments:
                        continue
                    own = h.get("warc-record-id", "").strip("<>")
                    rows.append((own, h.get("warc-type"), h.get("warc-target-uri"), h.get("warc-refers-to", "").strip("<>") or None, h.get("warc-payload-digest"), long(h.get("x-payload-length")), h.get("warc-segment-origin-id", own).strip("<>"), long(h.get("warc-segment-number")), long(h.get("warc-segment-total-length")), block))
                    size += len(block)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return arrow_map(spark.read.format("binaryFile").load(path).select("content"), run, RECORD)


DECODED = T.StructType([*RECORD.fields[:6], T.StructField("payload", T.BinaryType()), T.StructField("status", T.StringType())])


def _decode(records: DataFrame) -> DataFrame:
    """Blocks to payloads; ``block`` null: the segments didn't fit together."""

    def factory():
        def f(b: pa.RecordBatch) -> dict:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            blocks, kinds = col["block"].to_pylist(), col["record_type"].to_pylist()
            got = [None if x is None or k == "revisit" else payload_of(x) for x, k in zip(blocks, kinds, strict=True)]
            status = ["incomplete" if x is None else "ok" if k == "revisit" or p is not None else "malformed" for x, k, p in zip(blocks, kinds, got, strict=True)]
            for i, (p, d) in enumerate(zip(got, col["stated_digest"].to_pylist(), strict=True)):
                if p is not None and d and d.startswith("sha256:") and hashlib.sha256(p).hexdigest() != d[7:]:
                    got[i], status[i] = None, "digest"
            return col | {"payload": got, "status": status}

        return f

    return map_batches(records, factory, DECODED)


def reassembled(segments: DataFrame) -> DataFrame:
    """One row a segmented record; ``block`` is null unless numbers run from 1 and the lengths add up to the stated total."""
    first = lambda c: F.max(F.when(F.col("segment_number") == 1, F.col(c))).alias(c)
    parts = segments.groupBy("origin_id").agg(
        *[first(f.name) for f in RECORD.fields[:6]],
        F.sort_array(F.collect_list(F.struct("segment_number", "block"))).alias("parts"),
        F.max("total_length").alias("total_length"),
    )
    whole = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["block"]))
    number = F.transform("parts", lambda x: x["segment_number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    return parts.withColumn("whole", whole).withColumn("block", F.when(number & (F.octet_length("whole") == F.col("total_length")), F.col("whole"))).select(*[f.name for f in RECORD.fields[:6]], "block")


def records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives with their payloads, segmented ones put together again."""
    whole = read(spark, path, segments=False).select(*[f.name for f in RECORD.fields[:6]], "block")
    return _decode(whole.unionByName(reassembled(read(spark, path, segments=True))))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write(table(spark, sf_dir, "pages"), fresh_path(spark, "warc"))
    page = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)", 1).try_cast("long")
    return records(spark, path).select(
        page(F.col("record_id")).alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "stated_bytes").alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.regexp_extract("stated_digest", "sha256:(.*)", 1)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to_id")).alias("refers_to"),
    )


OP2_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM f
"""
