"""WARC records in ZIP packages: writer, and a reader that parses the central and ZIP64
directories, locates stored members and indexes, and range-reads records without extraction."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skytrail.llm.common import bounded_batches, small, stash, table

RESPONSE_MIN = 0  # payloads of fewer bytes are never revisits
ARCHIVE_BYTES = 4 << 20  # a package is closed once its records have that many bytes
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc", "indexes/index.cdxj"
CRLF = b"\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record, which has no payload."""
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>", "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{sha1}", "WARC-Date": "1970-01-01T00:00:00Z"}
    body = payload
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:page:{refers_to}>", "X-Payload-Length": str(len(payload))}
        body = b""
    head["Content-Length"] = str(len(body))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + CRLF + body + CRLF + CRLF


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].split(CRLF)
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    body = data[end + 4 : end + 4 + int(head["content-length"])]
    if len(body) != int(head["content-length"]):
        raise ValueError("a WARC record is cut short")
    return head, body


class Package:
    """Writes stored (uncompressed) members, so that records can be read in place."""

    def __init__(self, zip64: bool = False):
        self.out, self.members, self.zip64 = io.BytesIO(), [], zip64

    def add(self, name: str, data: bytes) -> None:
        at, raw, crc = self.out.tell(), name.encode(), zlib.crc32(data)
        big = self.zip64 or max(at, len(data)) >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        n = 0xFFFFFFFF if big else len(data)
        self.out.write(struct.pack("<4s5H3I2H", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 33, crc, n, n, len(raw), len(extra)) + raw + extra + data)
        self.members.append((raw, crc, len(data), at, big))

    def close(self) -> bytes:
        start = self.out.tell()
        for raw, crc, n, at, big in self.members:
            extra = struct.pack("<HHQQQ", 1, 24, n, n, at) if big else b""
            size, where = (0xFFFFFFFF, 0xFFFFFFFF) if big else (n, at)
            self.out.write(struct.pack("<4s6H3I5H2I", b"PK\1\2", 45, 45 if big else 20, 0x800, 0, 0, 33, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, where) + raw + extra)
        size, n = self.out.tell() - start, len(self.members)
        big = self.zip64 or start >= 0xFFFFFFFF or n >= 0xFFFF
        if big:
            end = self.out.tell()
            self.out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self.out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
        self.out.write(struct.pack("<4s4H2IH", b"PK\5\6", 0, 0, *(2 * [0xFFFF if big else n]), *((0xFFFFFFFF, 0xFFFFFFFF) if big else (size, start)), 0))
        return self.out.getvalue()


class Archive:
    """Reads a package through read(offset, length) alone: directories first, then ranges."""

    def __init__(self, read, size: int):
        self.read = read
        tail_at = max(0, size - 65557)
        tail = read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n == 0xFFFF or 0xFFFFFFFF in (length, start):
            mark, _, where, _ = struct.unpack("<4sIQI", read(tail_at + at - 20, 20))
            if mark != b"PK\6\7":
                raise ValueError("no ZIP64 locator")
            end = read(where, 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 directory")
            n, length, start = struct.unpack_from("<QQQ", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}  # name -> local header, size, method
        data, at = read(start, length), 0
        for _ in range(n):
            if data[at : at + 4] != b"PK\1\2":
                raise ValueError("bad central directory")
            method, _, _, _, packed, size_, ln, le, lc = struct.unpack_from("<HHHIIIHHH", data, at + 10)
            where = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + ln].decode()
            extra, e = data[at + 46 + ln : at + 46 + ln + le], 0
            while e + 4 <= len(extra):
                tag, span = struct.unpack_from("<HH", extra, e)
                if tag == 1:
                    wide = iter(struct.unpack_from(f"<{span // 8}Q", extra, e + 4))
                    size_ = next(wide) if size_ == 0xFFFFFFFF else size_
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    where = next(wide) if where == 0xFFFFFFFF else where
                e += 4 + span
            self.members[name] = (where, size_, method)
            at += 46 + ln + le + lc

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin."""
        where, _, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.read(where, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError("bad local header")
        return where + 30 + sum(struct.unpack_from("<HH", head, 26))

    def index(self) -> list[dict]:
        """The entries of all index members, in the order of their names."""
        names = sorted(x for x in self.members if x.startswith("indexes/") and not x.endswith("/"))
        if not names:
            raise ValueError("no index")
        out = []
        for name in names:
            try:
                out += [json.loads(x) for x in self.read(self.start(name), self.members[name][1]).splitlines()]
            except json.JSONDecodeError as e:
                raise ValueError(f"{name} is no index of JSON lines") from e
        return out

    def records(self) -> Iterator[tuple[dict, dict[str, str], bytes]]:
        """Each index entry with its record, one range read a record."""
        starts: dict[str, int] = {}
        for e in self.index():
            at = starts.get(e["filename"])
            if at is None:
                at = starts[e["filename"]] = self.start(e["filename"])
            yield e, *parse_record(self.read(at + e["offset"], e["length"]))


def write_packages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, payload, refers_to) rows become packages of about ARCHIVE_BYTES."""
    parts: list[bytes] = []
    entries: list[str] = []
    size = 0

    def flush() -> pa.RecordBatch:
        p = Package(zip64=len(entries) % 2 == 1)  # either kind of directory is legal at any size
        p.add(WARC_MEMBER, b"".join(parts))
        p.add(INDEX_MEMBER, "".join(entries).encode())
        return pa.RecordBatch.from_pydict({"n": pa.array([len(entries)], pa.int64()), "package": pa.array([p.close()], pa.large_binary())})

    for b in batches:
        for page, url, payload, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
            payload = payload or b""
            data = record(page, url, payload, digest(payload), refers)
            entries.append(json.dumps({"page_id": page, "filename": WARC_MEMBER, "offset": size, "length": len(data)}) + "\n")
            parts.append(data)
            size += len(data)
            if size >= ARCHIVE_BYTES:
                yield flush()
                parts, entries, size = [], [], 0
    if entries:
        yield flush()


def read_packages(payloads: bool):
    """(package) to a row a record; a package that cannot be read has one row with its error after those
    of the records before the fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package in b.column(0):
                rows = []
                try:
                    if not package.is_valid:
                        raise ValueError("no package")
                    buf = memoryview(package.as_buffer())
                    for entry, head, body in Archive(lambda at, n, buf=buf: bytes(buf[at : at + n]), len(buf)).records():
                        kind, sha1 = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                        refers = head.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                        if kind == "response" and digest(body) != sha1:
                            raise ValueError("a payload does not have its digest")
                        rows.append((entry["page_id"], head["warc-target-uri"], int(head.get("x-payload-length", len(body))), sha1, kind, int(refers) if refers else None, body if payloads and kind == "response" else None, None))
                except (LookupError, OverflowError, TypeError, ValueError, struct.error) as e:
                    rows.append((*[None] * 7, f"{type(e).__name__}: {e}"))
                cols = list(zip(*rows, strict=True)) or [()] * len(READ)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, READ, strict=True)], schema=READ)

    return run


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])


def write_archives(pages: DataFrame, min_bytes: int = RESPONSE_MIN) -> DataFrame:
    """A written table of packages (n, package) that hold a record for each row of pages.

    Of records with equal payloads the smallest page_id's is the response, others are revisits;
    payloads under min_bytes are all responses.  Null html is an empty payload.  Null page_id sorts
    last, and is never referred to unless all of a payload's ids are null.  Rows that repeat the
    smallest page_id are responses too.  No rows: no packages.
    """
    bounded_batches(pages.sparkSession)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    key = F.unhex(F.sha1("payload"))
    # Ids of each payload that more than one id has; payloads are shuffled only if these are too many
    # to broadcast.
    first = stash(rows.select("page_id", F.length("payload").alias("n"), key.alias("k")).filter(F.col("n") >= min_bytes).groupBy("k").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count("*").alias("c")).filter("first < last").select("k", "first"), "first")
    found = rows.withColumn("k", key).join(small(first, first.count()), "k", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return stash(found.select("page_id", "url", "payload", refers.alias("refers")).mapInArrow(write_packages, "n long, package binary"), "packages")


def read_archives(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (of
    responses, if they are asked for) and error.

    A package that is null, malformed or cut short has a row with its error and nothing else, beside
    the records before the fault; so has one whose payload lacks its digest.
    """
    return packages.select("package").mapInArrow(read_packages(payloads), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return read_archives(write_archives(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (
  select page_id, strlen(coalesce(html, '')) payload_bytes, sha1(coalesce(html, '')) h,
         min(page_id) over (partition by coalesce(html, '')) first_id from pages),
b as (
  select page_id, payload_bytes, first_id,
         list_transform(range(4), lambda c: ('0x' || substr(h, (c * 10 + 1)::int, 10))::bigint) chunks from p)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((chunks[(i // 8 + 1)::int] >> (35 - 5 * (i % 8))::int) & 31) + 1)::int, 1)), '') payload_digest,
       case when page_id = first_id then 'response' else 'revisit' end record_type,
       case when page_id <> first_id then first_id end refers_to
from b
"""
