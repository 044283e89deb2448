"""Legacy archive converter: ARC files of versions 1 and 2 to WARC, with synthesised identifiers, timestamps, types and digests.

read_arc() parses ARC files: the version block at a file's start (and wherever
another begins) names the version, the version gives the fields of each URL
record's header line, and the declared length gives the record's bytes, never a
search for a separator. to_warc() writes each record as a WARC record with a
version 8 UUID made of its place, an ISO timestamp, a type and SHA-1 digests; of records with
equal payloads of `least` bytes or more, the one with the largest page id is
the response, the others are revisits of it. read_warc() parses WARC files.
write_arc() makes ARC files of a table of pages, so that the round trip can be
tested and pages without an archive can enter here.

Files are written by Spark's text writer with the record separator as line
separator, gzip as compression, so they go to any file system that Spark
writes to, one file for each task, and survive lost executors by the writer's
commit protocol.

Scale: payloads are shuffled once, as compressed archive files next to their
revisit decisions; digests alone are aggregated, with partial aggregation, so
a payload that a third of all pages share costs one row for each task.

Edge cases: a null html is an empty payload, a null url is urn:page:<id>, white
space and controls in a url are percent-encoded; rows of one page_id each get a
record; among equal payloads all rows with the largest id are responses; a null
page_id is smaller than any other, and of records without any, one is the
response. A malformed ARC record ends its file: read_arc() names the fault, the
records before it are converted. An empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, scratch, work_path, written

ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "file", "length"),
}
#: Records after which the ARC writer begins a new version block, of the other version.
BLOCK = 500
DATE = "20200101000000"
#: Files that are in hand at once.
FILES = 4


def version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 foliant\n".encode()
    body += ("URL IP-address Archive-date Content-type Archive-length\n" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n").encode()
    line = f"filedesc://{name} 0.0.0.0 {DATE} text/plain"
    line += f" {len(body)}\n" if version == 1 else f" 200 - - 0 {name} {len(body)}\n"
    return line.encode() + body


def arc_record(version: int, name: str, url: str, http: bytes, offset: int) -> bytes:
    line = f"{url} 0.0.0.0 {DATE} text/html"
    line += f" {len(http)}\n" if version == 1 else f" 200 {hashlib.sha1(http).hexdigest()} - {offset} {name} {len(http)}\n"
    return line.encode() + http


def http_block(page: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode() + payload


def page_url(page: int | None, url: str | None) -> str:
    if not url:
        return f"urn:page:{'' if page is None else page}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def parse_arc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """(header fields, block) of every URL record. Raises ValueError where a header or a length is wrong."""
    at, version, end = 0, 0, len(data)
    while at < end:
        if data[at : at + 1] in (b"\n", b"\r"):  # between records
            at += 1
            continue
        stop = data.find(b"\n", at)
        if stop < 0:
            raise ValueError(f"no end of the header line at {at}")
        fields = data[at:stop].decode("utf-8", "surrogateescape").rstrip("\r").split(" ")
        if not fields[-1].isdigit():
            raise ValueError(f"no length in the header line at {at}")
        size = int(fields[-1])
        block = data[stop + 1 : stop + 1 + size]
        if len(block) < size:
            raise ValueError(f"the record at {at} is shorter than it declares")
        if fields[0].startswith("filedesc:"):
            first = block.split(b"\n", 1)[0].split(b" ", 1)[0]
            if first not in (b"1", b"2"):
                raise ValueError(f"unknown version at {at}")
            version = int(first)
        else:
            if not version or len(fields) != len(ARC_FIELDS[version]):
                raise ValueError(f"the header line at {at} doesn't fit version {version}")
            yield dict(zip(ARC_FIELDS[version], fields, strict=True)) | {"version": version, "at": at}, block
        at = stop + 1 + size


def split_http(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head with its empty line, its fields in lower case, and the payload."""
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep or not head.startswith(b"HTTP/"):
        return b"", {}, block
    fields = (x.partition(b":") for x in head.split(b"\r\n")[1:])
    return head + sep, {k.decode("latin-1").strip().lower(): v.decode("latin-1").strip() for k, _, v in fields}, payload


def page_of(http: dict[str, str]) -> int | None:
    """The page id that a head names, if any."""
    p = http.get("x-page-id", "")
    return int(p) if re.fullmatch("-?[0-9]{1,19}", p) and -(2**63) < int(p) < 2**63 else None


def record_at(page: int | None, path: str, at: int) -> str:
    """The identifier of the record made of what stands at a place of an ARC file."""
    return record_id(page, f"{path}:{at}".encode())


def record_id(page: int | None, salt: bytes) -> str:
    """A UUID of version 8 that holds the page id in its first 48, next 12 and next 4 free bits, and a hash."""
    page = -(2**63) if page is None else page
    bits = page & (2**64 - 1)
    rest = int.from_bytes(hashlib.sha1(salt).digest()[:8], "big") & (2**58 - 1)
    n = (bits >> 16) << 80 | 8 << 76 | ((bits >> 4) & 0xFFF) << 64 | 2 << 62 | (bits & 0xF) << 58 | rest
    h = f"{n:032x}"
    return f"urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def record_page(uuid: str) -> int | None:
    n = int(uuid.removeprefix("<").removesuffix(">").removeprefix("urn:uuid:").replace("-", ""), 16)
    page = (n >> 80) << 16 | ((n >> 64) & 0xFFF) << 4 | ((n >> 58) & 0xF)
    page -= 2**64 if page >= 2**63 else 0
    return None if page == -(2**63) else page


def iso(arc_date: str) -> str:
    """An ARC date of 8 to 14 digits as a WARC date."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14] if arc_date.isdigit() and len(arc_date) < 14 else arc_date[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def base32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def warc_record(kind: str, uuid: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{uuid}>"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogateescape") + b"\r\n" + block


def convert(header: dict, block: bytes, path: str, refers_to: str | None) -> bytes:
    """The WARC record of one ARC record; refers_to: the identifier of the response that it repeats, if any."""
    head, http, payload = split_http(block)
    fields = [
        ("WARC-Target-URI", header["url"]),
        ("WARC-Date", iso(header["date"])),
        ("WARC-IP-Address", header["ip"]),
        ("WARC-Payload-Digest", base32(hashlib.sha1(payload).digest())),
        ("Content-Type", "application/http; msgtype=response" if head else header["mime"]),
    ]
    own = record_at(page_of(http), path, header["at"])
    if refers_to is None:
        # what is no HTTP message is a resource
        return warc_record("response" if head else "resource", own, [*fields, ("WARC-Block-Digest", base32(hashlib.sha1(block).digest()))], block)
    fields += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", f"<{refers_to}>"),
        ("WARC-Block-Digest", base32(hashlib.sha1(head).digest())),
    ]
    return warc_record("revisit", own, fields, head)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of every record, by declared lengths."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        lines = data[at:stop].split(b"\r\n")[1:]
        fields = {k.decode().lower(): v.decode("utf-8", "surrogateescape").strip() for k, _, v in (x.partition(b":") for x in lines)}
        size = int(fields["content-length"])
        block = data[stop + 4 : stop + 4 + size]
        if len(block) < size:
            raise ValueError(f"the record at {at} is shorter than it declares")
        yield fields, block
        at = stop + 4 + size
        if data[at : at + 4] == b"\r\n\r\n":
            at += 4


def unpacked(content: bytes) -> bytes:
    """Contents of a file that may be of gzip members."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        d = zlib.decompressobj(31)
        out += [d.decompress(content), d.flush()]
        content = d.unused_data
    return b"".join(out)


def _store(df: DataFrame, path: str, separator: str) -> None:
    """Write each row's bytes as a record; the fastest compression."""
    df.select(F.col("record").cast("string").alias("value")).write.option("lineSep", separator).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    # Spark's writers leave markers beside the parts
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def write_arc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """ARC files of pages, versions 1 and 2 in turn."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = offset = 0
        version = 1
        for b in batches:
            out = []
            for page, url, html in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                front = b""
                if n % BLOCK == 0:
                    version = 1 + n // BLOCK % 2
                    front = version_block(version, "pages.arc") + b"\n"
                out.append(front + arc_record(version, "pages.arc", page_url(page, url), http_block(page, html or b""), offset + len(front)))
                offset += len(out[-1]) + 1
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    cols = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("binary").alias("html"))
    _store(cols.mapInArrow(rows, "record binary"), path, "\n")


ARC_ROWS = "path string, at bigint, url string, date string, page_id bigint, payload_bytes bigint, digest binary, error string"


def readable(data: bytes) -> Iterator[tuple[dict | None, bytes, str | None]]:
    """(header fields, block, None) of every record up to the first that is malformed, which is (None, b"", what is wrong)."""
    try:
        for h, block in parse_arc(data):
            yield h, block, None
    except ValueError as x:
        yield None, b"", str(x)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, without its payload; where a file is malformed, one last row of it with `error`."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, out = b.column(0)[i].as_py(), []
                for h, block, error in readable(unpacked(b.column(1)[i].as_py())):
                    if h is None:
                        out.append((name, None, None, None, None, None, None, error))
                        continue
                    _, http, payload = split_http(block)
                    out.append((name, h["at"], h["url"], h["date"], page_of(http), len(payload), hashlib.sha1(payload).digest(), None))
                types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["path", "at", "url", "date", "page_id", "payload_bytes", "digest", "error"])

    return _files(spark, path).mapInArrow(rows, ARC_ROWS)


def revisits(records: DataFrame, least: int = 1000) -> DataFrame:
    """(path, at, top) of every record that repeats another's payload of so many bytes; top: page_id, path and at of that response.

    The response is the record with the largest page id, nulls smallest, then
    with the last path and place. Records with its page id are responses too.
    """
    some = records.where((F.col("payload_bytes") >= least) & F.col("error").isNull())
    own = F.struct("page_id", "path", "at")
    first = written(some.groupBy("digest", "payload_bytes").agg(F.max(own).alias("top"), F.count("*").alias("n")).where("n > 1").drop("n"), "responses")
    other = F.when(F.col("top.page_id").isNull(), ~own.eqNullSafe(F.col("top"))).otherwise(~F.col("page_id").eqNullSafe(F.col("top.page_id")))
    return some.join(first, ["digest", "payload_bytes"]).where(other).select("path", "at", "top")


def to_warc(spark: SparkSession, arc_path: str, warc_path: str, least: int = 1000) -> None:
    """Convert all ARC files under a path to WARC files; of a malformed file, the records before its first fault."""
    again = written(revisits(written(read_arc(spark, arc_path), "records", FILES), least), "revisits")
    # a file's decisions are as many as its records at most
    by_file = again.groupBy("path").agg(F.collect_list(F.struct("at", "top")).alias("again"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                name, content, again = (b.column(c)[i].as_py() for c in range(3))
                refers = {x["at"]: record_at(x["top"]["page_id"], x["top"]["path"], x["top"]["at"]) for x in again or ()}
                out, size = [], 0
                for h, block, _ in readable(unpacked(content)):
                    if h is None:
                        continue
                    out.append(convert(h, block, name, refers.get(h["at"])))
                    size += len(out[-1])
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    files = _files(spark, arc_path).join(by_file, "path", "left").select("path", "content", "again")
    with batches_of(spark, FILES):
        _store(files.mapInArrow(rows, "record binary"), warc_path, "\r\n\r\n")


WARC_ROWS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, refers_to_id string, uri string, date string"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record. The digest of a response is computed anew and must be the declared one. A revisit's payload_bytes is what its head declares, null if nothing."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                out = []
                for f, block in parse_warc(unpacked(b.column(1)[i].as_py())):
                    _, http, payload = split_http(block)
                    declared = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                    kind = f["warc-type"]
                    whole = kind != "revisit"
                    if whole and hashlib.sha1(payload).hexdigest() != declared:
                        raise ValueError(f"digest of {f['warc-record-id']} differs")
                    length = http.get("content-length", "")
                    size = len(payload) if whole else int(length) if length.isdigit() else None
                    to = None if whole else f["warc-refers-to"]
                    out.append((record_page(f["warc-record-id"]), size, declared, kind, record_page(to) if to else None, f["warc-record-id"], to, f["warc-target-uri"], f["warc-date"]))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_id", "uri", "date"])

    return _files(spark, path).mapInArrow(rows, WARC_ROWS)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Pages to ARC files, those to WARC files, and these read back: one row per page."""
    spark = pages.sparkSession
    with scratch(spark):
        arc, warc = work_path(spark, "arc"), work_path(spark, "warc")
        write_arc(pages, arc)
        to_warc(spark, arc, warc, least)
        back = read_warc(spark, warc).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
        return written(back, "records", FILES, keep=True)


#: The same rows in DuckDB over the view pages; it has SHA-1 of text.
SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE b >= 1000 GROUP BY d)
SELECT page_id, CAST(b AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN b >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM p LEFT JOIN m USING (d)
"""
