"""WARC archives with segmented records.

Writing: one record per page. A page whose payload an earlier page has is a revisit of it; others are
responses, an HTTP message in chunked framing. A block over the segment size goes on in continuation
records that name the origin record, their segment number and, in the last, the total length.
Records are dealt to archives by themselves, so the segments of one record may lie in several files.

Reading: archives are cut into records by their Content-Length. Records of one segment are decoded
where they are read; the others are grouped by origin, ordered by segment number, verified against
the total length, and decoded from their chunks. Payloads of responses are held against their digests, and what
revisits claim against the responses that they name.

Defined cases: a null payload is empty; repeated rows are records of their own (a page_id never
revisits itself); a null page_id is kept, and revisits any page with its payload that has one; an empty
table writes no record. Only page_id and the payload column are read. A missing segment, a wrong
total or broken framing raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, cut, delete_path, fresh_path, rows

CRLF = b"\r\n"
#: Bytes of a record's block before it goes on in a continuation.
SEGMENT_BYTES = 16_384
CHUNK_BYTES = 4096
#: Bytes of payload in an archive, about.
ARCHIVE_BYTES = 16_000_000
#: Records to a file at most, so that a file can be read whole.
RECORDS_PER_FILE = 4000
_DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """HTTP/1.1 chunked framing of a payload."""
    parts = [b"%x\r\n%b\r\n" % (len(c), c) for c in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions and trailers are read over."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            raise ValueError("chunk size is missing")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            if body.find(CRLF, at) < 0:
                raise ValueError("last chunk is cut short")
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


@dataclass
class Record:
    """One WARC record: named fields and a block."""

    fields: dict[str, str]
    block: bytes

    def written(self) -> bytes:
        """The record's bytes, without the two line ends that follow it."""
        fields = {**self.fields, "Content-Length": str(len(self.block))}
        return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields.items()) + CRLF + self.block


def parse(archive: bytes) -> Iterator[Record]:
    """The records of an archive."""
    at = 0
    while at < len(archive):
        end = archive.find(b"\r\n\r\n", at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise ValueError("not a WARC record")
        lines = archive[at:end].decode().split("\r\n")[1:]
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields.pop("Content-Length"))
        block = archive[end + 4 : end + 4 + length]
        at = end + 4 + length
        if len(block) != length or archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError("record is cut short")
        at += 4
        yield Record(fields, block)


def inflated(archive: bytes) -> bytes:
    """An archive without compression: all its gzip members, of which writers often make one for each record; a plain one as it is.

    A member that is cut short raises ValueError, as does anything that stands between members, but for zero bytes at the end.
    """
    if not archive.startswith(b"\x1f\x8b"):
        return archive
    out = []
    while archive:
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(archive))
        except zlib.error as e:
            raise ValueError(f"broken member of an archive: {e}") from None
        if not member.eof:
            raise ValueError("an archive is cut short")
        archive = member.unused_data.lstrip(b"\x00")
    return b"".join(out)


def segments(record_id: str, fields: dict[str, str], block: bytes, size: int = SEGMENT_BYTES) -> list[Record]:
    """A record as one segment, or as its origin and continuations."""
    name = f"<urn:uuid:{record_id}>"
    if len(block) <= size:
        return [Record({"WARC-Record-ID": name, **fields}, block)]
    out = []
    for number, at in enumerate(range(0, len(block), size), 1):
        own = {"WARC-Segment-Number": str(number)}
        if number == 1:
            own = {"WARC-Record-ID": name, **fields, **own}
        else:
            own = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_SPACE, f'{record_id}/{number}')}>", "WARC-Type": "continuation", "WARC-Date": _DATE, "WARC-Segment-Origin-ID": name, **own}
        if at + size >= len(block):
            own["WARC-Segment-Total-Length"] = str(len(block))
        out.append(Record(own, block[at : at + size]))
    return out


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of a record from its (segment number, total length or None, block)."""
    parts = sorted(parts, key=lambda p: p[0])
    if [p[0] for p in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("a segment is missing or doubled")
    block = b"".join(p[2] for p in parts)
    if parts[-1][1] != len(block):
        raise ValueError("segments do not add up to the total length")
    return block


def _digest(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a whole record."""
    page = fields.get("X-Page-ID")
    kind, refers = fields["WARC-Type"], fields.get("X-Refers-To-Page-ID")
    if kind == "revisit":
        size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    else:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = unchunked(body) if b"chunked" in head else body
        size, digest = len(payload), payload_digest(payload)
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError("payload does not match its digest")
    return (None if page is None else int(page)), size, digest, kind, (None if refers is None else int(refers))




def write_archives(pages: DataFrame, path: str, payload: str = "html", revisit_from: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write all pages as WARC files.

    The first page of each payload is a grouped minimum over digests; a page meets it in one join on
    the digest, in which Spark may split a payload that many pages share.
    """
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"))
    page = page.select("page_id", "html", F.sha1(F.col("html").cast("binary")).alias("sha1"))
    first = page.where(F.octet_length("html") >= revisit_from).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha1", "first")
    joined = page.join(first, "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    marked = joined.select("page_id", F.when(revisit, F.col("first")).alias("refers"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            records: list[bytes] = []
            for page_id, refers, html in rows(batch, "page_id", "refers", "html"):
                body = html.encode()
                digest = payload_digest(body)
                own = {} if page_id is None else {"X-Page-ID": str(page_id)}
                fields = {"WARC-Type": "response", "WARC-Date": _DATE, "WARC-Target-URI": f"urn:page:{page_id}", "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http;msgtype=response", **own}
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
                block = head + chunked(body)
                if refers is not None:
                    fields |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": f"urn:page:{refers}", "X-Refers-To-Page-ID": str(refers), "X-Payload-Length": str(len(body))}
                    block = head
                records += [r.written() for r in segments(str(uuid.uuid5(_SPACE, f"{page_id}/{part}/{n}")), fields, block, segment_bytes)]
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    # Archives of a useful size, and no fewer than can be written at once.
    size = page.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    archives = max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // ARCHIVE_BYTES))
    made = marked.coalesce(archives).mapInArrow(write, "record binary")
    made.select(F.col("record").cast("string").alias("record")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


_PARTS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("head", pa.string()), ("block", pa.binary())]
)
_PARTS_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, origin string, number int, total long, head string, block binary"
_RESULT = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def read_archives(files: DataFrame) -> DataFrame:
    """One row per whole record of archives, given as (content) rows: gzip of one or many members, or plain."""
    import json

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items() -> Iterator[tuple]:
            for batch in batches:
                for (content,) in rows(batch, "content"):
                    for r in parse(inflated(content or b"")):
                        number = r.fields.get("WARC-Segment-Number")
                        if number is None:
                            yield *_digest(r.fields, r.block), None, None, None, None, None
                        else:
                            origin = r.fields.get("WARC-Segment-Origin-ID", r.fields["WARC-Record-ID"])
                            total = r.fields.get("WARC-Segment-Total-Length")
                            head = json.dumps(r.fields) if number == "1" else None
                            yield None, None, None, None, None, origin, int(number), (None if total is None else int(total)), head, r.block

        yield from batched(_PARTS, items(), 500)

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([_PARTS.field(c) for c in _RESULT])

        def items() -> Iterator[tuple]:
            for batch in batches:
                for (parts,) in rows(batch, "parts"):
                    heads = [p["head"] for p in parts if p["number"] == 1]
                    block = reassemble([(p["number"], p["total"], p["block"]) for p in parts])
                    yield _digest(json.loads(heads[0]), block)

        yield from batched(schema, items(), 2000)

    found = cut(files.select("content").mapInArrow(cut_up, _PARTS_DDL))
    whole = found.where("origin IS NULL").select(*_RESULT)
    parts = found.where("origin IS NOT NULL").groupBy("origin").agg(F.collect_list(F.struct("number", "total", "head", "block")).alias("parts"))
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return whole.unionByName(parts.select("parts").mapInArrow(join_up, ddl))


def check_revisits(records: DataFrame) -> None:
    """Every payload that a revisit claims is one that the page it names was a response with; else ValueError.

    Claims are made distinct before they are dealt, so a page that very many revisit is one row.
    """
    claims = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest", "payload_bytes").distinct()
    responses = records.where("record_type = 'response'").select("page_id", "payload_digest", "payload_bytes").distinct()
    lost = claims.join(responses, ["page_id", "payload_digest", "payload_bytes"], "left_anti").first()
    if lost is not None:
        raise ValueError(f"no response of page {lost['page_id']} has the payload {lost['payload_digest']}")


def warc_digest(pages: DataFrame, payload: str = "html") -> DataFrame:
    """Write the pages below the shared folder and return what the archives give back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, payload)
    out = cut(read_archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)))
    check_revisits(out)
    delete_path(spark, path)
    return out


#: The same rows in DuckDB; base32 is read off the digest's bits.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, strlen(body) AS n, unhex(sha1(body))::BIT::VARCHAR AS bits FROM p
), e AS (
  SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
      + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), '') AS digest FROM d
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, count(*) OVER (PARTITION BY digest) AS copies FROM e
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN copies > 1 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN copies > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
