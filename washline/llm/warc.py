"""WARC archives: writing pages as records, reading them back, joining segments.

Writing: a page whose payload an earlier chosen page already has becomes a revisit record, the others
response records. A response's payload is framed as chunks (HTTP/1.1), and a block above
``segment`` bytes is cut into a first record and continuation records. Spark's own text writer puts
the records into files below the shared folder: the separator of its lines is the end of a record, so
the files are plain WARC (gzip), and only files of finished tasks count.

Reading: whole archives, of bounded size, are parsed by their content lengths. Records without segments
are done at once; first and continuation records are grouped by the id of their origin, put in order of
their segment number, checked against the total length, and only then unframed.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, written

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
SEGMENT = 32 << 10
CHUNK = 4 << 10
BLOCK = 2 << 20
BLOCKS_PER_ARCHIVE = 4  # an archive stays below 8 MB of records, and one record
DATE = b"2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """A record, a segment or a chunk does not have the length that it states."""


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(name: str) -> bytes:
    return b"<urn:uuid:%s>" % str(uuid.uuid5(uuid.NAMESPACE_URL, name)).encode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [payload[i: i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The data of chunked framing; chunk extensions and trailers are read over."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at)
        if stop < 0:
            raise BrokenArchive("a chunk has no size")
        try:
            size = int(body[at:stop].split(b";")[0].strip(), 16)
        except ValueError:
            raise BrokenArchive("a chunk's size is no number") from None
        at = stop + 2
        if size == 0:
            return b"".join(out)
        if body[at + size: at + size + 2] != b"\r\n":
            raise BrokenArchive("a chunk is shorter or longer than it says")
        out.append(body[at: at + size])
        at += size + 2


def record(kind: bytes, headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without its end mark."""
    lines = [VERSION, b"WARC-Type: " + kind, b"WARC-Date: " + DATE]
    lines += [name + b": " + value for name, value in headers]
    lines.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(lines) + END + block


def page_records(
    page: str, name: str, payload: bytes, origin: str | None, target: str | None, segment: int = SEGMENT
) -> list[bytes]:
    """The records of one page. ``page`` is its id as text, ``name`` makes the record id; ``origin`` and
    ``target`` are name and page of the response that a revisit points at, None for a response."""
    own = record_id(name)
    digest = b"sha1:" + base32_digest(payload).encode()
    common = [(b"WARC-Target-URI", b"urn:page:" + page.encode()), (b"WARC-Payload-Digest", digest)]
    if origin is not None:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [record(b"revisit", [
            (b"WARC-Record-ID", own), *common, (b"WARC-Profile", REVISIT_PROFILE),
            (b"WARC-Refers-To", record_id(origin)),
            (b"WARC-Refers-To-Target-URI", b"urn:page:" + (target or "").encode()),
            (b"Content-Type", b"application/http; msgtype=response"),
        ], block)]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = (b"Content-Type", b"application/http; msgtype=response")
    if len(block) <= segment:
        return [record(b"response", [(b"WARC-Record-ID", own), *common, kind], block)]
    parts = [block[i: i + segment] for i in range(0, len(block), segment)]
    out = [record(b"response", [
        (b"WARC-Record-ID", own), *common, kind, (b"WARC-Segment-Number", b"1"),
    ], parts[0])]
    for number, part in enumerate(parts[1:], 2):
        headers = [
            (b"WARC-Record-ID", record_id(f"{name}/{number}")), (b"WARC-Segment-Origin-ID", own),
            (b"WARC-Segment-Number", b"%d" % number),
        ]
        if number == len(parts):
            headers.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(record(b"continuation", headers, part))
    return out


def _responses(pages: DataFrame) -> DataFrame:
    """``pages`` with ``origin_row`` and ``origin_page``: the page that holds the payload, null on that
    page itself. It is the one with the largest page id, of several rows with it the one with the
    largest row number; a page without id only where the group has no other."""
    keyed = pages.withColumn("digest", F.sha1("payload"))
    # written, so that Spark can split a payload that very many pages share
    best = written(keyed.groupBy("digest").agg(F.max(F.struct("page", "row")).alias("best")))
    joined = keyed.join(best, "digest")
    revisit = F.col("row") != F.col("best.row")
    return joined.select(
        "page", "row", "payload", F.when(revisit, F.col("best.row")).alias("origin_row"),
        F.when(revisit, F.col("best.page")).alias("origin_page"),
    )


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", payload: str = "html",
    segment: int = SEGMENT,
) -> None:
    """One WARC record for each page below ``path``; a null payload is empty.

    Rows with repeated or null ids are pages of their own. The table is scanned twice and its rows must
    come in the same order both times, as those of stored files do.
    """
    numbered = pages.select(
        F.col(f"`{key}`").alias("page"), F.monotonically_increasing_id().alias("row"),
        F.encode(F.coalesce(F.col(f"`{payload}`"), F.lit("")), "utf-8").alias("payload"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for page, row, value, origin, target in zip(*(c.to_pylist() for c in batch.columns)):
                for one in page_records(
                    _text(page), f"{_text(page)}/{row}", value,
                    None if origin is None else f"{_text(target)}/{origin}", _text(target), segment,
                ):
                    held.append(one)
                    size += len(one) + len(END)
                    if size >= BLOCK:
                        yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["value"])
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([END.join(held)], pa.binary())], ["value"])

    blocks = _responses(numbered).mapInArrow(run, "value binary")
    (
        blocks.select(F.col("value").cast("string")).write
        .option("lineSep", END.decode()).option("compression", "gzip")
        .option("maxRecordsPerFile", BLOCKS_PER_ARCHIVE).text(path)
    )


def _text(page) -> str:
    return "" if page is None else str(page)


@dataclass
class Record:
    kind: str
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


def parse(content: bytes) -> Iterator[Record]:
    """The records of one archive, plain or gzip with any number of members."""
    if content[:2] == b"\x1f\x8b":
        plain = []
        while content:
            member = zlib.decompressobj(wbits=31)
            plain.append(member.decompress(content) + member.flush())
            content = member.unused_data
        content = b"".join(plain)
    at = 0
    while at < len(content):
        stop = content.find(END, at)
        if stop < 0 or not content.startswith(b"WARC/", at):
            raise BrokenArchive("a record does not start where the one before it ends")
        lines = content[at:stop].decode().split("\r\n")[1:]
        headers = {name.lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        begin = stop + len(END)
        end = begin + int(headers["content-length"])
        if content[end: end + len(END)] != END:
            raise BrokenArchive("a record is shorter or longer than it says")
        yield Record(headers["warc-type"], headers, content[begin:end])
        at = end + len(END)


PARSED = pa.schema([
    ("kind", pa.string()), ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()),
    ("page", pa.string()), ("digest", pa.string()), ("refers_to", pa.string()), ("block", pa.binary()),
])
PARSED_SQL = (
    "kind string, origin string, segment int, total long, page string, digest string, "
    "refers_to string, block binary"
)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives below ``path``; ``segment`` is null for whole ones."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [_row(r) for r in parse(content.as_py())]
                for i in range(0, len(rows), 256):
                    columns = zip(*rows[i: i + 256])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, PARSED)], schema=PARSED
                    )

    return files.mapInArrow(run, PARSED_SQL)


def _row(r: Record) -> tuple:
    h = r.headers
    number = h.get("warc-segment-number")
    total = h.get("warc-segment-total-length")
    return (
        r.kind, h.get("warc-segment-origin-id", h["warc-record-id"]), number and int(number),
        total and int(total), _page(h.get("warc-target-uri")),
        h.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        _page(h.get("warc-refers-to-target-uri")), r.block,
    )


def _page(uri: str | None) -> str | None:
    return None if uri is None else uri.removeprefix("urn:page:") or None


def reassemble(records: DataFrame) -> DataFrame:
    """``(page, kind, digest, refers_to, block)``: whole blocks. Segments are grouped by origin - one
    page each - sorted by number, and must be complete and as long as the last one states."""
    whole = records.where("segment IS NULL").select("page", "kind", "digest", "refers_to", "block")
    parts = records.where("segment IS NOT NULL").groupBy("origin").agg(
        F.max("page").alias("page"), F.max("digest").alias("digest"), F.max("total").alias("total"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"),
    )
    numbers = F.transform("parts", lambda p: p["segment"])
    complete = numbers == F.sequence(F.lit(1), F.size("parts"))
    joined = parts.select(
        "page", F.lit("response").alias("kind"), "digest", F.lit(None).cast("string").alias("refers_to"),
        F.when(complete, F.transform("parts", lambda p: p["block"])).alias("blocks"), "total",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks, total in zip(batch.column(4), batch.column(5).to_pylist()):
                if not blocks.is_valid:
                    raise BrokenArchive("segments of a record are missing")
                value = b"".join(blocks.as_py())
                if len(value) != total:
                    raise BrokenArchive("the segments of a record do not add up to its length")
                out.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(out, pa.binary())],
                ["page", "kind", "digest", "refers_to", "block"],
            )

    return whole.unionByName(joined.mapInArrow(
        run, "page string, kind string, digest string, refers_to string, block binary"
    ))


def payloads(blocks: DataFrame) -> DataFrame:
    """``(page, payload_bytes, payload_digest, record_type, refers_to, payload)`` of whole blocks; the
    payload is null for a revisit. A response whose payload does not have the digest that its record
    states raises."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, values = [], []
            kinds, digests = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for kind, digest, block in zip(kinds, digests, batch.column(4).to_pylist()):
                head, _, body = block.partition(END)
                fields = dict(
                    (n.strip().lower(), v.strip()) for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])
                )
                if kind == "revisit":
                    sizes.append(int(fields[b"content-length"]))
                    values.append(None)
                    continue
                payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                if digest and base32_digest(payload) != digest:
                    raise BrokenArchive("a payload does not have its digest")
                sizes.append(len(payload))
                values.append(payload)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), batch.column(1),
                batch.column(3), pa.array(values, pa.binary()),
            ], ["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return blocks.select("page", "kind", "digest", "refers_to", "block").mapInArrow(
        run, "page string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to string, payload binary"
    )


def round_trip(
    pages: DataFrame, key: str = "page_id", payload: str = "html", segment: int = SEGMENT
) -> DataFrame:
    """The pages written as archives in a new shared folder and read back, ids in their own type."""
    path = new_folder(pages.sparkSession)
    kind = pages.schema[key].dataType
    write_archives(pages, path, key, payload, segment)
    found = payloads(reassemble(read_records(pages.sparkSession, path)))
    return found.select(
        F.col("page").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"), "payload",
    )
