"""WARC archives: writing, segmentation, revisits, reading back and reassembly.

Archives are written by Spark's own text writer with the record terminator as line
separator, so they go to any store that Spark can write to, and files hold at most
``FILE_RECORDS`` records of at most ``SEGMENT_BYTES`` each. A block over that size is
cut into a first segment and continuation records. Reading parses whole files in
Python, hands complete records on at once, and groups only segmented ones by their
origin: ordered by segment number, checked for gaps and against the total length,
joined, and freed of the HTTP header and the chunked framing.

Of records with equal payloads of at least ``least_bytes`` bytes, that with the
smallest id is the response; the others are revisits that carry the digest and the
length, but no payload. Digests are bare upper-case base32 SHA-1.

Edge cases: a null payload is empty; a null id stays null (and is never another's
response); rows that repeat an id and payload are responses all; an unreadable or
incomplete record raises ValueError; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import bound_batches, checkpointed, map_rows, ship

CRLF = b"\r\n"
END = "\r\n\r\n"
FILE_RECORDS, SEGMENT_BYTES, CHUNK_BYTES = 4000, 64 << 10, 16 << 10
BROADCAST_ROWS = 500_000


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked transfer framing."""
    out = []
    for k in range(0, len(payload), size):
        part = payload[k : k + size]
        out += [b"%X\r\n" % len(part), part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Undo ``chunked``; chunk extensions and trailers are read over."""
    out, at = [], 0
    while True:
        line = body.index(CRLF, at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk's length is wrong")
        out.append(body[at : at + size])
        at += size + 2


def record(headers: dict[str, str | int], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers.items()), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + b"\r\n\r\n" + block


def records_of(origin: str, page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, segment: int = SEGMENT_BYTES) -> list[bytes]:
    """The records of one capture; ``first`` is the response that it revisits, if it does."""
    kind = "response" if first is None else "revisit"
    own: dict[str, str | int] = {"WARC-Type": kind, "WARC-Record-ID": origin, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{digest}"}
    if url:
        own["WARC-Target-URI"] = " ".join(url.split())
    if page_id is not None:
        own["X-Page-ID"] = page_id
    own["Content-Type"] = "application/http; msgtype=response"
    if first is not None:
        own |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [record(own, b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return [record(own, block)]
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    out = [record(own | {"WARC-Segment-Number": 1}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more: dict[str, str | int] = {"WARC-Type": "continuation", "WARC-Record-ID": f"{origin[:-1]}:{k}>", "WARC-Segment-Origin-ID": origin, "WARC-Segment-Number": k}
        if k == len(parts):
            more["WARC-Segment-Total-Length"] = len(block)
        out.append(record(more, part))
    return out


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, segment: int = SEGMENT_BYTES) -> None:
    """Write ``pages`` as gzipped WARC files under ``path``."""
    own = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))

    # Digest and length are built-ins here: only they are shuffled, never a payload.
    marked = own.select("page_id", F.sha1(F.col("html").cast("binary")).alias("hex"), F.octet_length("html").alias("bytes"))
    groups = marked.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("hex").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = checkpointed(groups.where("n > 1").select("hex", "first"))
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    full = own.withColumn("hex", F.sha1(F.col("html").cast("binary"))).join(groups, "hex", "left").drop("hex")
    bound_batches(pages.sparkSession)
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = []
            raw = batch.column("html").cast(pa.binary())
            for i, u, payload, first in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), raw, batch.column("first").to_pylist(), strict=True):
                body = payload.as_py()
                seen = first if first is not None and i is not None and first != i else None
                out += records_of(f"<urn:record:{part}-{n}>", i, u or "", body, digest_of(body), seen, segment)
                n += 1
                if len(out) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = full.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(path)


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin where it should")
        headers = {}
        while (line := stream.readline()) not in (CRLF, b"\n", b""):
            k, _, v = line.decode("utf-8").partition(":")
            headers[k.strip().lower()] = v.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        yield headers, block


def payload_of(block: bytes) -> tuple[bytes, dict[str, str]]:
    """An HTTP response's payload without transfer framing, and its headers."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.decode("latin-1").partition(":") for x in head.split(CRLF)[1:]))
    return (unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body), headers


def joined(parts: list[tuple[int, bytes]], total: int | None) -> bytes:
    """Segments in order; numbers must run from 1 without gaps, and the length must be right."""
    parts = sorted(parts)
    block = b"".join(x for _, x in parts)
    if [k for k, _ in parts] != list(range(1, len(parts) + 1)) or total is None or len(block) != total:
        raise ValueError("segments are missing or repeated")
    return block


FOUND = [("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("digest", T.StringType()), ("origin", T.StringType()), ("segment", T.IntegerType()), ("total", T.LongType()), ("payload_bytes", T.LongType()), ("payload", T.BinaryType())]


def _row(headers: dict[str, str], block: bytes, whole: bool) -> tuple:
    kind = headers["warc-type"]
    number = int(headers.get("warc-segment-number", 1))
    total = headers.get("warc-segment-total-length")
    told = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    page = headers.get("x-page-id")
    refers = headers.get("warc-refers-to")
    origin = headers.get("warc-segment-origin-id") or headers["warc-record-id"]
    size = None
    if whole:
        payload, http = payload_of(block)
        if kind == "revisit":
            size, block = int(http["content-length"]), None
        else:
            if digest_of(payload) != told:
                raise ValueError("a payload's digest is wrong")
            size, block = len(payload), payload
    return int(page) if page else None, headers.get("warc-target-uri"), kind, int(refers[len("<urn:page:") : -1]) if refers else None, told, origin, number, int(total) if total else None, size, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of every capture."""
    bound_batches(spark)
    ship(spark)
    schema = T.StructType([T.StructField(n, t) for n, t in FOUND])
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_py()
                rows, held = [], 0
                for headers, block in parse(io.BytesIO(zlib.decompress(raw, 47)) if raw[:2] == b"\x1f\x8b" else io.BytesIO(raw)):
                    # A lone first segment has no number; a numbered one waits for the others.
                    rows.append(_row(headers, block, headers["warc-type"] != "continuation" and "warc-segment-number" not in headers))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    found = files.mapInArrow(run, schema)
    whole = found.where(F.col("payload_bytes").isNotNull())
    cut = found.where(F.col("payload_bytes").isNull())
    grouped = cut.groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("url").alias("url"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.collect_list(F.struct("segment", "payload")).alias("parts")
    )

    def assemble():
        def step(batch):
            payloads = []
            for parts, total, told in zip(batch.column("parts"), batch.column("total").to_pylist(), batch.column("digest").to_pylist(), strict=True):
                payload, _ = payload_of(joined([(x["segment"], x["payload"]) for x in parts.as_py()], total))
                if digest_of(payload) != told:
                    raise ValueError("a payload's digest is wrong")
                payloads.append(payload)
            return [payloads]

        return step

    full = map_rows(grouped, assemble, [("payload", T.BinaryType())], ["page_id", "url", "digest"])
    full = full.select("page_id", "url", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload")
    return whole.select("page_id", "url", "record_type", "refers_to", F.col("digest").alias("payload_digest"), "payload_bytes", "payload").unionByName(full)
