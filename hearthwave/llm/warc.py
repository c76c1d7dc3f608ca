"""Legacy archives to WARC: ARC files are parsed by their headers' declared lengths and given WARC records.

An ARC file starts with a version block (``filedesc://``) whose second line tells the version: version 1 headers
are ``URL IP date type length``, version 2 adds result code, checksum, location, offset and file name before the
length. A record's body is a reply, its HTTP head first; one without a head (of a page, say) is given one. Each
record's identifier, date, type and digests for WARC are derived from these, so that the same archive always gives
the same records. Payloads that occurred before become revisit records, with the head alone.

Bodies are bytes throughout, whatever their encoding. Written archives are files in the folder the cluster shares:
each record is a gzip member of its own, and the writer's separator is a member without content. A file holds about
FILE_BYTES, and starts with a warcinfo record. Archives are read again by the records' declared lengths.

Defined cases: a null page counts as empty; a null url as ``urn:none``; bytes of a header that aren't UTF-8 are
escaped by percent signs. Pages are the same payload if their bytes are; the one with the smallest ``page_id`` is the
response, and rows that repeat its page_id too. Payloads shorter than ``least`` bytes are all responses. Rows with a
null ``page_id`` are responses unless their payload occurs under an id.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store

#: The header lines of the two versions, and the line that ends a record.
VERSION_1 = "URL IP-address Archive-date Content-type Archive-length"
VERSION_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
END = "\r\n\r\n"
#: A gzip member without content, which separates the records of a file.
GAP = gzip.compress(b"", mtime=0)
#: Bytes of a file's records, about: a task begins another one then.
FILE_BYTES = 64 << 20
#: Bytes that are unpacked at once.
PIECE = 1 << 13
DATE = "20240101000000"

RECORD = "page_id string, url string, date string, head binary, payload binary, sha1 string"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_header(version: int, url: str, ip: str, date: str, content_type: str, length: int, checksum: str = "-", name: str = "-") -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url)
    if version == 1:
        return f"{url} {ip} {date} {content_type} {length}\n".encode()
    return f"{url} {ip} {date} {content_type} 200 {checksum} - 0 {name} {length}\n".encode()


def arc_start(version: int, name: str, date: str = DATE) -> bytes:
    """The version block that opens an archive."""
    body = f"{version} 0 hearthwave\n{VERSION_1 if version == 1 else VERSION_2}\n".encode()
    return arc_header(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", len(body), name=name) + body + b"\n"


def header_text(raw: bytes) -> str:
    """A header line as text: bytes that aren't UTF-8 are escaped."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 0x80 else f"%{b:02X}" for b in raw)


def http_head(content_type: str, length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {content_type}\r\nContent-Length: {length}\r\n\r\n".encode()


def split_body(body: bytes, content_type: str) -> tuple[bytes, bytes]:
    """HTTP head and payload of a record's body."""
    end = body.find(b"\r\n\r\n") + 4
    return (body[:end], body[end:]) if body.startswith(b"HTTP/") and end > 3 else (http_head(content_type, len(body)), body)


def parse_arc(raw: bytes) -> Iterator[dict]:
    """url, ip, date, content_type and body of each record; the version comes from the opening block."""
    at, version = 0, 0
    while at < len(raw):
        line_end = raw.find(b"\n", at)
        if line_end < 0:
            raise ValueError("an ARC header without an end")
        header = header_text(raw[at:line_end]).split(" ")
        if not header[-1].isdigit() or len(header) not in (5, 10):
            raise ValueError(f"not an ARC header: {header[:2]}")
        length = int(header[-1])
        body = raw[line_end + 1 : line_end + 1 + length]
        if len(body) < length:
            raise ValueError("an ARC record shorter than declared")
        at = line_end + 1 + length + 1
        if not version:
            version = int(body.split(b" ", 1)[0])
            if len(header) != (5 if version == 1 else 10):
                raise ValueError("the opening block's header is of another version")
            continue
        yield {"url": header[0], "ip": header[1], "date": header[2], "content_type": header[3], "body": body}


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(parts))}>"


def warc_date(date: str) -> str:
    """yyyyMMddHHmmss as WARC writes it."""
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    fields = [*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + END.encode()


def warc_info(name: str, date: str = DATE) -> bytes:
    """The record that opens a file."""
    block = b"software: hearthwave\r\nformat: WARC File Format 1.1\r\ndescription: converted from ARC\r\n"
    return _record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", name)), ("WARC-Date", warc_date(date)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], block)


def warc_record(record: dict) -> bytes:
    """A response, or (``refers_to`` a page) a revisit, which has the HTTP head and the payload's digest."""
    page_id, payload, first = record["page_id"] or "", record["payload"], record.get("refers_to")
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", record_id(record["url"], record["date"], page_id)),
        ("WARC-Date", warc_date(record["date"])),
        ("WARC-Target-URI", record["url"]),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-ID", page_id),
        ("X-Payload-Length", str(len(payload))),
    ]
    if first is None:
        return _record(fields, record["head"] + payload)
    url, date = record["refers_url"], record["refers_date"]
    fields += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(url, date, first)),
        ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", warc_date(date)), ("X-Refers-To-Page", first),
    ]
    return _record(fields, record["head"])


def members(raw: bytes) -> Iterator[bytes]:
    """The contents of a gzip file's members that have some, one after the other."""
    view, at = memoryview(raw), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + PIECE]  # what is left over of a piece is copied, so that pieces are small
            if not len(piece):
                raise ValueError("a gzip member without an end")
            parts.append(d.decompress(piece))
            at += len(piece)
        at -= len(d.unused_data)
        if any(parts):
            yield b"".join(parts)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record."""
    at = 0
    while at < len(raw):
        head_end = raw.find(b"\r\n\r\n", at)
        lines = header_text(raw[at:head_end]).split("\r\n")
        if head_end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC header")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start = head_end + 4
        end = start + int(fields["Content-Length"])
        if raw[end : end + 4] != END.encode():
            raise ValueError("a WARC record of another length than declared")
        yield fields, raw[start:end]
        at = end + 4


def to_arc(pages: DataFrame, per_archive: int = 500) -> DataFrame:
    """(page_ids, content): legacy archives of a run of pages each, versions 1 and 2 by turns."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in it:
            for at in range(0, b.num_rows, per_archive):
                rows = b.slice(at, per_archive).to_pylist()
                turn += 1
                version = 1 + turn % 2
                name = f"part-{turn}.arc"
                parts = [arc_start(version, name)]
                for r in rows:
                    payload = r["html"] or b""
                    body = http_head("text/html", len(payload)) + payload
                    parts += [arc_header(version, r["url"] or "urn:none", "0.0.0.0", DATE, "text/html", len(body), name=name), body, b"\n"]
                yield pa.RecordBatch.from_arrays([pa.array([[r["page_id"] for r in rows]], pa.list_(pa.string())), pa.array([b"".join(parts)], pa.binary())], names=["page_ids", "content"])

    chosen = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"))
    return chosen.mapInArrow(batches, "page_ids array<string>, content binary")


def from_arc(archives: DataFrame) -> DataFrame:
    """The records of archives (page_ids, content); without page_ids, a record's number counts."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = content.as_py()
                found = list(parse_arc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw))
                ids = ids or [str(i) for i in range(len(found))]
                split = [split_body(r["body"], r["content_type"]) for r in found]
                columns = [pa.array(ids, pa.string()), *(pa.array([r[k] for r in found], pa.string()) for k in ("url", "date")), *(pa.array(c, pa.binary()) for c in ([h for h, _ in split], [p for _, p in split]))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([hashlib.sha1(p).hexdigest() for _, p in split], pa.string())], names=["page_id", "url", "date", "head", "payload", "sha1"])

    return archives.select("page_ids", "content").mapInArrow(batches, RECORD)


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Records as gzip WARC files below ``path``; ``refers_to`` (with refers_url and refers_date) makes a revisit.

    Spark's text writer takes the bytes as they are; ISO-8859-1 is how it is told the separator's bytes.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = 0, file_bytes
        for b in it:
            for at in range(0, b.num_rows, 100):
                made, parts = [], []
                for r in b.slice(at, 100).to_pylist():
                    if held >= file_bytes:
                        part, held = part + 1, 0
                        made.append(gzip.compress(warc_info(f"part-{part}"), 6, mtime=0))
                        parts.append(part)
                    made.append(gzip.compress(warc_record(r), 6, mtime=0))
                    parts.append(part)
                    held += len(made[-1])
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(parts, pa.int32())], names=["value", "part"])

    chosen = records.select("page_id", "url", "date", "head", "payload", "refers_to", "refers_url", "refers_date").mapInArrow(batches, "value binary, part int")
    chosen.select(F.col("value").cast("string").alias("value"), "part").write.partitionBy("part").option("encoding", "ISO-8859-1").option("lineSep", GAP.decode("latin-1")).text(path)


def read_warc(archives: DataFrame) -> DataFrame:
    """Per response or revisit of archives (content): page_id, payload_bytes, payload_digest, record_type, refers_to, all as written."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for content in b.column(0):
                raw = content.as_py()
                out = []
                for fields, block in (x for part in (members(raw) if raw[:2] == b"\x1f\x8b" else [raw]) for x in parse_warc(part)):
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    name = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = split_body(block, "")[1]
                    if fields["WARC-Type"] == "response" and (digest(payload) != name or len(payload) != int(fields["X-Payload-Length"])):
                        raise ValueError("a record's payload isn't the one it names")
                    out.append({"page_id": fields["X-Page-ID"] or None, "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": name, "record_type": fields["WARC-Type"], "refers_to": fields.get("X-Refers-To-Page")})
                yield pa.RecordBatch.from_pylist(out, schema=_READ)

    return archives.select("content").mapInArrow(batches, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")


_READ = pa.schema([("page_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string())])


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages to legacy archives, those to WARC, and the WARC archives read back.

    Per page: page_id, payload_bytes, payload_digest, record_type, refers_to. ``page_id`` must be a number.
    """
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    raw = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    url = F.coalesce(F.col("url").cast("string"), F.lit("urn:none"))
    told = pages.where(F.col("page_id").isNotNull()).select(F.sha1(raw).alias("sha1"), F.octet_length(raw).alias("n"), F.struct("page_id", url.alias("url")).alias("first"))
    first = told.where(F.col("n") >= least).groupBy("sha1").agg(F.min("first").alias("first")).select("sha1", F.col("first.page_id").cast("string").alias("first"), F.col("first.url").alias("first_url"))
    records = from_arc(to_arc(pages)).join(first, "sha1", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    first_url = F.regexp_replace("first_url", r"\s", "%20")
    path = store.new_path(spark, "warc")
    write_warc(records.withColumns({"refers_to": F.when(again, F.col("first")), "refers_url": F.when(again, first_url), "refers_date": F.when(again, F.col("date"))}), path)
    back = read_warc(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path))
    return back.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: For DuckDB; base32 five bits at a time.
ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) || '0' AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(x, (5 * i) // 4 + 1, 2))::INT) >> (3 - (5 * i) % 4)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
