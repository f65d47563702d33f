"""Writing pages as WARC archives with segmented, chunk-framed records, and reading archives back."""

from __future__ import annotations

import base64
import gzip
import io
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a record's block above which it continues in another record.
SEGMENT_BYTES = 32 << 10
#: Bytes of a chunk of the HTTP body.
CHUNK_BYTES = 8 << 10
#: Records of an archive file; a reader holds one file at a time.
FILE_BYTES = 64 << 20
RECORDS_PER_FILE = 4000

_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, sha1: str) -> str:
    """The record identifier of a page's response, the same whenever it is written."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page} {sha1}'.encode()).digest())}>"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    out = [b"%x\r\n%b\r\n" % (len(part), part) for k in range(0, len(payload), size) if (part := payload[k : k + size])]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a body in chunked transfer framing; extensions and trailers are passed over."""
    at, out = 0, []
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        part = body[at : at + size]
        if len(part) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is shorter than it says")
        out.append(part)
        at += size + 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message, without its transfer framing."""
    head, _, body = block.partition(_END)
    fields = dict(line.lower().split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    if fields.get(b"transfer-encoding", b"").strip() == b"chunked":
        return unchunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + _END + block


def response_records(page: object, url: str | None, payload: bytes, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[bytes]:
    """The response record of a page and, beyond ``segment_bytes``, its continuations."""
    sha1 = digest(payload)
    own = record_id(page, sha1)
    block = _HTTP + chunked(payload, chunk_bytes)
    common = [("WARC-Target-URI", _one_line(url)), ("WARC-Date", date), ("Page-Id", page)]
    parts = [block[k : k + segment_bytes] for k in range(0, len(block), segment_bytes)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha1:{sha1}"), ("Content-Type", "application/http;msgtype=response")]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = len(block) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{own} {k}'.encode()).digest())}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", last)], part)


def revisit_record(page: object, url: str | None, sha1: str, original: object, date: str) -> bytes:
    return _record(
        [
            ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(f"{page} revisits {original}", sha1)), ("WARC-Target-URI", _one_line(url)), ("WARC-Date", date), ("Page-Id", page),
            ("WARC-Payload-Digest", f"sha1:{sha1}"), ("WARC-Refers-To", record_id(original, sha1)), ("Refers-To-Page-Id", original),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ],
        b"",
    )


def _one_line(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def write_archives(
    pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES, chunk_bytes: int = CHUNK_BYTES, records_per_file: int | None = None, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write a record for every page into gzip-compressed archives below ``path``.

    Of pages with equal payloads (UTF-8 of the html; null is empty) of at
    least ``min_revisit_bytes`` bytes, the one with the smallest id becomes a
    response and the others revisits of it.  Payloads are equal if SHA-1, MD5
    and length are.  Groups are found by partial sums on the map side and
    joined back to the pages by an equi-join that adaptive execution splits.
    Files are written by Spark's text sink, so a lost executor's files are
    written again and a failed job leaves no half archives.

    A file has as many records as ``FILE_BYTES`` hold on average (measured
    first), ``RECORDS_PER_FILE`` at most, unless ``records_per_file`` is given;
    a record has ``segment_bytes`` at most, so a very long page is spread over
    several, and reading holds a file's compressed bytes and a few records.

    Rows that repeat an id and payload are all responses or all revisits; rows
    with a null id revisit a row with an id if there is one.  Empty payloads
    are equal payloads like others.  An empty table gives no records; other
    columns, whatever their names, are ignored.
    """
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    if records_per_file is None:
        mean = own.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
        records_per_file = int(min(RECORDS_PER_FILE, max(1, FILE_BYTES // (mean + 512))))
    own = own.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).withColumn("md5", F.md5(F.col("html").cast("binary")))
    same = own.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("sha1", "md5").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    told = own.join(same.select(F.col("sha1").alias("s"), F.col("md5").alias("m"), "first"), (F.col("sha1") == F.col("s")) & (F.col("md5") == F.col("m")), "left")
    told = told.select("id", "url", "html", F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("original"))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            size = 0
            for page, url, html, original in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                if original is not None:
                    out.append(revisit_record(page, url, digest(payload), original, date))
                else:
                    out += response_records(page, url, payload, date, segment_bytes, chunk_bytes)
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # a record ends with two line ends, which the sink writes as its line separator
    told.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_PARSED = "warc_type string, record_id string, origin_id string, page_id long, url string, segment int, total long, digest string, refers_to_id string, refers_to long, block binary"


def parse_archive(raw: bytes) -> Iterator[tuple]:
    """The records of an archive (compressed or not), in the order of ``_PARSED``; one record is decompressed at a time."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw))) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError("no record where one should begin")
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) != size or stream.read(len(_END)) != _END:
            raise ValueError(f"the record {fields.get('warc-record-id')} doesn't end where it says")
        number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
        yield (
            fields["warc-type"], fields["warc-record-id"], fields.get("warc-segment-origin-id") or fields["warc-record-id"], number("page-id"), fields.get("warc-target-uri"),
            number("warc-segment-number"), number("warc-segment-total-length"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, fields.get("warc-refers-to"), number("refers-to-page-id"), block,
        )


_READ = "page_id long, url string, record_type string, record_id string, refers_to_id string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _finished(page, url, own, said, block: bytes) -> tuple:
    payload = payload_of(block)
    found = digest(payload)
    if said is not None and said != found:
        raise ValueError(f"the payload of {own} doesn't have its digest")
    return page, url, "response", own, None, None, found, len(payload), payload


def _rows(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]


_READ_NAMES = [f.split()[0] for f in _READ.split(", ")]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The responses and revisits of the archives below ``path``, payloads whole.

    Records in one piece are decoded where they are read.  Pieces of segmented
    records, wherever they lie, are grouped by the identifier of their origin,
    ordered by segment number, checked against the total length that the last
    one states, and decoded.  A missing segment, a wrong length or a wrong
    digest fails the job.  A record that was written r times is returned r
    times.  A revisit has no payload of its own; see :func:`resolved`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _PARSED.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for r in parse_archive(content.as_py()):
                    if r[0] == "response" and r[5] is None:
                        page, url, _, own, _, _, said, n, payload = _finished(r[3], r[4], r[1], r[7], r[10])
                        r = ("whole", own, own, page, url, None, n, said, None, None, payload)
                    elif r[0] not in ("response", "continuation", "revisit"):
                        continue
                    rows.append(r)
                    size += len(r[10])
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def join(table):
        first = table.to_pylist()
        by: dict[int, list[dict]] = {}
        for r in first:
            by.setdefault(r["segment"], []).append(r)
        times = {len(v) for v in by.values()}
        if sorted(by) != list(range(1, len(by) + 1)) or len(times) != 1 or by[1][0]["warc_type"] != "response":
            raise ValueError(f"segments of {first[0]['origin_id']} are missing")
        block = b"".join(by[k][0]["block"] for k in range(1, len(by) + 1))
        if by[len(by)][0]["total"] != len(block):
            raise ValueError(f"segments of {first[0]['origin_id']} don't have their total length")
        head = by[1][0]
        return pa.Table.from_arrays(_rows([_finished(head["page_id"], head["url"], head["record_id"], head["digest"], block)] * times.pop()), names=_READ_NAMES)

    parsed = files.mapInArrow(parse, _PARSED)
    pieces = parsed.filter("warc_type IN ('response', 'continuation')").groupBy("origin_id").applyInArrow(join, _READ)
    whole = parsed.filter("warc_type IN ('whole', 'revisit')").select(
        "page_id", "url", F.when(F.col("warc_type") == "whole", "response").otherwise("revisit").alias("record_type"), "record_id", "refers_to_id", "refers_to", F.col("digest").alias("payload_digest"), F.when(F.col("warc_type") == "whole", F.col("total")).alias("payload_bytes"),
        F.when(F.col("warc_type") == "whole", F.col("block")).alias("payload"),
    )
    return whole.union(pieces)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` without payloads, each revisit with the length and digest of the response it refers to.

    A revisit whose response is missing or has another digest fails the job.
    """
    narrow = records.select("page_id", "url", "record_type", "record_id", "refers_to_id", "refers_to", "payload_digest", "payload_bytes")
    responses = narrow.filter("record_type = 'response'").groupBy("record_id").agg(F.first("payload_digest").alias("their_digest"), F.first("payload_bytes").alias("their_bytes"))
    revisits = narrow.filter("record_type = 'revisit'").join(responses.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    checked = F.when(F.col("their_digest").eqNullSafe(F.col("payload_digest")), F.col("their_bytes")).otherwise(F.raise_error(F.lit("a revisit's response is missing")).cast("long"))
    columns = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes"]
    return narrow.filter("record_type = 'response'").select(*columns).union(revisits.withColumn("payload_bytes", checked).select(*columns))
