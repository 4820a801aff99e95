"""Python data source for archives of captures: WARC 1.1, one gzip member per record.

Write: df (url, body, digest, revisit_of, captured_at seconds) with `.write.format("crawl_archive")
.option("path", folder)`. Each task writes files of at most `max_bytes`, named with `prefix`, each with a
warcinfo record first if an `operator` is given; they become visible by a rename when the job commits. `digest`
(sha1, sha256 or none) is taken of bodies that come without one. Rows whose discard_reason, if there is such
a column, isn't null are not written. Read: `.read.format("crawl_archive").load(folder)`.

Folders are local paths or addresses of any store that Arrow opens (file, hdfs, s3, gs).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "url string, body binary, digest string, revisit_of string, captured_at long"


def encode(url: str, body: bytes | None, digest: str | None, revisit_of: str | None, captured_at: int | None) -> bytes:
    date = datetime.fromtimestamp(captured_at or 0, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = b"" if revisit_of else bytes(body or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit_of else 'resource'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Target-URI: {url}", f"WARC-Date: {date}"]
    if digest:
        head.append(f"WARC-Payload-Digest: {digest if ':' in digest else f'sha256:{digest}'}")
    if revisit_of:
        head += [f"WARC-Refers-To-Target-URI: {revisit_of}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


def info(operator: str) -> bytes:
    """The record that says who wrote a file."""
    block = f"operator: {operator}\r\nformat: WARC File Format 1.1\r\n".encode()
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


class ArchiveWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")
        self.limit = int(options.get("max_bytes", 1 << 30))
        self.prefix, self.operator, self.digest = options.get("prefix", ""), options.get("operator", ""), options.get("digest", "none").lower()
        if self.digest not in ("none", "sha1", "sha256"):
            raise ValueError(f"unknown digest: {self.digest}")

    def write(self, rows: Iterator) -> Written:
        store, folder = fs.FileSystem.from_uri(self.folder)
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for r in rows:
            have = r.asDict()
            if have.get("discard_reason"):
                continue
            if out is None or size > self.limit:
                if out:
                    out.close()
                name = f"{folder}/{self.prefix}{uuid.uuid4().hex}.warc.gz"
                files.append((f"{name}.open", name))
                out, size = store.open_output_stream(f"{name}.open", compression=None), 0
                if self.operator:
                    out.write(info(self.operator))
            digest = have.get("digest")
            if digest is None and self.digest != "none" and have.get("body") is not None:
                digest = f"{self.digest}:{hashlib.new(self.digest, bytes(have['body'])).hexdigest()}"
            raw = encode(have["url"], have["body"], digest, have.get("revisit_of"), have.get("captured_at"))
            out.write(raw)
            size += len(raw)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for a, b in m.files if m else ():
                store.move(a, b)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = fs.FileSystem.from_uri(self.folder)
        for m in messages:
            for a, _ in m.files if m else ():
                if store.get_file_info(a).type == fs.FileType.File:
                    store.delete_file(a)


@dataclass
class ArchiveFile(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        store, folder = fs.FileSystem.from_uri(self.folder)
        return [ArchiveFile(x.path) for x in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path) if x.path.endswith(".warc.gz")]

    def read(self, partition: ArchiveFile) -> Iterator[tuple]:
        store, _ = fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(partition.path, compression=None) as raw, gzip.open(raw, "rb") as f:
            while line := f.readline():
                if not line.startswith(b"WARC/"):
                    continue
                head = {}
                while (line := f.readline().strip()) != b"":
                    k, _, v = line.decode().partition(":")
                    head[k.strip().lower()] = v.strip()
                body = f.read(int(head["content-length"]))
                if head["warc-type"] == "warcinfo":
                    continue
                late = head["warc-type"] == "revisit"
                when = int(datetime.strptime(head["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
                digest = head.get("warc-payload-digest", "").removeprefix("sha256:") or None
                yield head["warc-target-uri"], None if late else body, digest, head.get("warc-refers-to-target-uri"), when


class CrawlArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "crawl_archive"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options)
