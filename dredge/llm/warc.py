"""WARC archives in ZIP packages: writing, and reading by ranges without extraction.

A package is a ZIP file whose members are stored, not deflated: `archive/data.warc.gz`, one gzip
member per WARC record, and `indexes/index.cdx`, one line of JSON per record with its offset and length
in that member. The reader reads the end of the file, follows the ZIP64 locator if there is one,
parses the central directory, finds where a stored member's bytes begin, and then range-reads single
records by the index; nothing is unpacked to disk. Neighbouring ranges are read together.

Records with equal payloads of at least `least` bytes are written once: the one with the largest
page_id is the response, others are revisits that refer to it. Equality is by SHA-1 and length; the
largest id per payload is a native aggregate, so a payload of a third of all pages is one row.

Packages are written by tasks to the shared folder, each attempt to names of its own; the written
table of paths that attempts return decides which packages count. Any scheme that pyarrow's file
systems know will do. Null html is an empty payload. A row without page_id is a response. Rows that
repeat the largest page_id are all responses. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dredge.llm.common import shared_path, written

LEAST = 1000
#: Payload bytes of a package, bytes that one read fetches at most, and bytes looked through for the end record.
PACKAGE_BYTES, READ_BYTES, TAIL = 64 << 20, 8 << 20, 66_000
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
_FULL = 0xFFFFFFFF


# --- ZIP ---------------------------------------------------------------------------------------


def zip_package(members: list[tuple[str, bytes]], zip64: bool = True) -> bytes:
    """A ZIP file of stored members; zip64 writes sizes and offsets in ZIP64 fields throughout."""
    out, central = io.BytesIO(), io.BytesIO()
    for name, data in members:
        raw, crc, at = name.encode(), zlib.crc32(data), out.tell()
        small = _FULL if zip64 else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if zip64 else b""
        version = 45 if zip64 else 20
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", version, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra)) + raw + extra + data)
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if zip64 else b""
        central.write(
            struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", version, version, 0x800, 0, 0, 0x21, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, _FULL if zip64 else at)
            + raw + extra
        )
    at, size, n = out.tell(), central.tell(), len(members)
    out.write(central.getvalue())
    if zip64:
        end = out.tell()
        out.write(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, at))
        out.write(struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1))
        at, size, n = _FULL, _FULL, 0xFFFF
    out.write(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, n, n, size, at, 0))
    return out.getvalue()


def directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (method, place of its local header, stored size); read(offset, length) fetches bytes."""
    start = max(0, size - TAIL)
    tail = read(start, size - start)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, n, length, offset, _ = struct.unpack_from("<HHHHIIH", tail, at + 4)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end,) = struct.unpack_from("<Q", tail, at - 12)
        record = read(end, 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        n, length, offset = struct.unpack_from("<QQQ", record, 32)
    found, raw, p = {}, read(offset, length), 0
    for _ in range(n):
        if raw[p : p + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        method, stored, plain = *struct.unpack_from("<H", raw, p + 10), *struct.unpack_from("<II", raw, p + 20)
        names, extras, notes = struct.unpack_from("<HHH", raw, p + 28)
        (place,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + names].decode()
        e, stop = p + 46 + names, p + 46 + names + extras
        while e + 4 <= stop:
            kind, width = struct.unpack_from("<HH", raw, e)
            if kind == 1:
                q = e + 4
                if plain == _FULL:
                    q += 8
                if stored == _FULL:
                    (stored,) = struct.unpack_from("<Q", raw, q)
                    q += 8
                if place == _FULL:
                    (place,) = struct.unpack_from("<Q", raw, q)
            e += 4 + width
        found[name] = (method, place, stored)
        p = stop + notes
    return found


def member_place(read, entry: tuple[int, int, int]) -> int:
    """Where the bytes of a stored member begin."""
    method, place, _ = entry
    if method != 0:
        raise ValueError("member is not stored")
    head = read(place, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    names, extras = struct.unpack_from("<HH", head, 26)
    return place + 30 + names + extras


# --- WARC --------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload but its digest and length."""
    url = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Target-URI: {url}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}", f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
        block = http
    else:
        block = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and HTTP payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    rows = head.decode().split("\r\n")
    if not rows[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    found = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rows[1:])}
    block = rest[: int(found["content-length"])]
    return found, block.partition(b"\r\n\r\n")[2]


# --- tables ------------------------------------------------------------------------------------


def _open(path: str):
    """File system and path in it, of a URI or a plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _package(rows: list[tuple]) -> bytes:
    data, index = io.BytesIO(), []
    for page_id, url, payload, kind, refers_to in rows:
        at = data.tell()
        data.write(gzip.compress(record(page_id, url, payload, kind, refers_to), 1, mtime=0))
        index.append(json.dumps({"page_id": page_id, "offset": at, "length": data.tell() - at}))
    return zip_package([(INDEX, "\n".join(index).encode()), (DATA, data.getvalue())])


def write(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write packages to the shared folder; returns the written table (path, records)."""
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest = F.concat(F.sha1(F.col("html").cast("binary")), F.lit("-"), F.octet_length("html").cast("string"))
    keyed = rows.withColumn("digest", digest)
    same = keyed.where(F.octet_length("html") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("top"))
    # Written, so that the join below shuffles both sides and a hot payload's pages can be split.
    same = written(same.where("n > 1 and top is not null").select("digest", "top"), "payloads")
    late = F.col("top").isNotNull() & (F.col("page_id") < F.col("top"))
    planned = keyed.join(same, "digest", "left").select(
        "page_id", "url", "html", F.when(late, "revisit").otherwise("response").alias("kind"), F.when(late, F.col("top")).alias("refers_to")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held):
            where, base = _open(folder)
            where.create_dir(base, recursive=True)
            path = f"{base}/{uuid.uuid4().hex}.wacz"
            with where.open_output_stream(path) as f:
                f.write(_package(held))
            name = f"{folder}/{path.rsplit('/', 1)[1]}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64())], ["path", "records"])

        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = row[2].encode("utf-8", "surrogatepass")
                if held and size + len(payload) > PACKAGE_BYTES:
                    yield flush(held)
                    held, size = [], 0
                held.append((row[0], row[1], payload, row[3], row[4]))
                size += len(payload)
        if held:
            yield flush(held)

    return written(planned.mapInArrow(run, "path string, records long"), "packages")


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a package in index order, by range reads of at most READ_BYTES (or one record)."""
    where, name = _open(path)
    with where.open_input_file(name) as f:
        read = lambda at, n: f.read_at(n, at)
        found = directory(read, f.size())
        start, size = member_place(read, found[INDEX]), found[INDEX][2]
        index = [json.loads(x) for x in read(start, size).decode().split("\n") if x]
        base, i = member_place(read, found[DATA]), 0
        while i < len(index):
            j, first = i + 1, index[i]["offset"]
            while j < len(index) and index[j]["offset"] + index[j]["length"] - first <= READ_BYTES and index[j]["offset"] == index[j - 1]["offset"] + index[j - 1]["length"]:
                j += 1
            chunk = read(base + first, index[j - 1]["offset"] + index[j - 1]["length"] - first)
            for x in index[i:j]:
                yield parse(gzip.decompress(chunk[x["offset"] - first : x["offset"] - first + x["length"]]))
            i = j


def read(packages: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of packages (column path); payload is null for revisits, or if not asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _READ.split(", "))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                size = 0
                for head, payload in records(path):
                    kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response":
                        n, seen = len(payload), hashlib.sha1(payload).hexdigest()
                        if seen != digest:
                            raise ValueError(f"{path}: payload of page {head['x-page-id']} does not have its digest")
                    else:
                        n = int(head["x-payload-length"])
                    body = payload if payloads and kind == "response" else None
                    refers = head.get("x-refers-to-page-id")
                    rows.append((int(head["x-page-id"]) if head["x-page-id"] else None, n, digest, kind, int(refers) if refers else None, head["warc-target-uri"], body))
                    size += len(body or b"")
                    if len(rows) >= 5000 or size > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    n = max(1, packages.count())
    spread = packages.select("path").repartition(min(n, 10_000), "path")
    return spread.mapInArrow(run, _READ)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write all pages, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(write(pages, least), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
