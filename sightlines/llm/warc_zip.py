"""WARC archives packed in ZIP files: written by tasks, read by ranges without extraction.

A package is a ZIP file that stores (does not deflate) one WARC file of gzip members, one member per record, and an
index with a line per record. The reader takes the end of the file, follows the ZIP64 locator where there is one, reads
the central directory and the members' local headers, fetches the index by range and then only the records asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import SLICE_ROWS, exploded, new_folder, stored

#: Paths inside a package.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.jsonl"
#: Records of one read task, at most; a range read takes this many bytes at least where records lie together.
TASK_RECORDS, READ_BYTES = 4_000, 1 << 20
#: Payload bytes after which a task begins another package.
PACKAGE_BYTES = 256 << 20

_END, _END64, _LOCATOR, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
_TARGET = "urn:page:"


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """The same id for a page and its payload in every run, so that tasks can be repeated."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{_TARGET}{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record: a response with its payload, or a revisit without."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", None if page_id is None else str(page_id)),
    ]
    reply = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-Id", str(refers_to)),
        ]
    body = reply + payload if refers_to is None else reply
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def _one_line(url: str | None) -> str | None:
    return None if url is None else "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url)


class _Counted(io.RawIOBase):
    """Lets zipfile write to a stream without seeking, and counts."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


class Package:
    """A package being written."""

    def __init__(self, stream):
        self.raw = _Counted(stream)
        self.zip = zipfile.ZipFile(self.raw, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, data: bytes) -> None:
        member = gzip.compress(data, 5, mtime=0)
        self.member.write(member)
        self.lines.append(json.dumps({"page_id": page_id, "offset": self.at, "length": len(member)}))
        self.at += len(member)

    def close(self) -> None:
        self.member.close()
        self.zip.writestr(INDEX, "".join(line + "\n" for line in self.lines))
        self.zip.close()


@dataclass(frozen=True)
class Member:
    """A stored file of a ZIP archive: where its bytes lie."""

    name: str
    method: int
    start: int
    size: int


def members(source) -> dict[str, Member]:
    """The members of a ZIP archive from its central directory; ``source`` has size() and read_at(length, offset)."""
    size = source.size()
    tail_at = max(0, size - 65_557)
    tail = source.read_at(size - tail_at, tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack_from("<10xHLL", tail, end)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start) or tail[max(0, end - 20) : end].startswith(_LOCATOR):
        if tail[end - 20 : end - 16] != _LOCATOR:
            raise ValueError("no ZIP64 locator")
        (at,) = struct.unpack_from("<8xQ", tail, end - 20)
        wide = source.read_at(56, at)
        if wide[:4] != _END64:
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack_from("<32xQQQ", wide)
    directory, out, at = source.read_at(length, start), {}, 0
    for _ in range(count):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("broken central directory")
        method, packed, full, n_name, n_extra, n_note, local = struct.unpack_from("<10xH8xLLHHH8xL", directory, at)
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        full, packed, local = _wide(extra, full, packed, local)
        header = source.read_at(30, local)
        if header[:4] != _LOCAL:
            raise ValueError(f"no local header of {name}")
        skip = struct.unpack_from("<26xHH", header)
        out[name] = Member(name, method, local + 30 + sum(skip), packed)
        at += 46 + n_name + n_extra + n_note
    return out


def _wide(extra: bytes, *values: int) -> list[int]:
    """Sizes and offset, of which those that are full come from the ZIP64 field."""
    at, wide = 0, b""
    while at + 4 <= len(extra):
        kind, length = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = extra[at + 4 : at + 4 + length]
        at += 4 + length
    out, at = [], 0
    for value in values:
        if value == 0xFFFFFFFF:
            (value,) = struct.unpack_from("<Q", wide, at)
            at += 8
        out.append(value)
    return out


class Source:
    """A file on any file system that Arrow knows, read by ranges."""

    def __init__(self, path: str):
        system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
            fs.LocalFileSystem(), path
        )
        self.file = system.open_input_file(inner)

    def size(self) -> int:
        return self.file.size()

    def read_at(self, length: int, offset: int) -> bytes:
        return self.file.read_at(length, offset)


def _stored_member(source, name: str) -> Member:
    found = members(source).get(name)
    if found is None or found.method:
        raise ValueError(f"{name} is not a stored member")
    return found


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-cased) and block of a WARC record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def with_originals(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to): of equal payloads the one with the largest page_id is the original.

    A page_id may stand on several rows, with the same payload or another. A null page_id is below all others; where
    a payload has no other, each of its rows is an original. ``digest`` is the SHA-1 as hexadecimal text.
    """
    digest = F.sha1(F.coalesce("html", F.lit(""))).alias("digest")
    hashed = pages.select("page_id", "url", "html", digest)
    made = stored(hashed.select("page_id", "digest").distinct(), "payloads")
    largest = made.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies"))
    revisits = made.join(largest.filter("copies > 1"), "digest").filter("coalesce(page_id < refers_to, refers_to IS NOT NULL)")
    revisits = revisits.select(F.col("page_id").alias("own_id"), F.col("digest").alias("own_digest"), "refers_to")
    same = F.expr("page_id <=> own_id AND digest = own_digest")
    return hashed.join(revisits, same, "left").drop("own_id", "own_digest")


def written(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes packages into a shared folder: (path, n_records), one row per package.

    Null html is an empty payload; a row without page_id gets a record as well. A repeated task writes files of its own, and only
    those it names in its result count. ``folder`` is a path or URI that all executors share.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (
            fs.LocalFileSystem(), folder
        )
        system.create_dir(inner, recursive=True)
        package, name, stream, records, done = None, "", None, 0, []

        def finish() -> None:
            package.close()
            stream.close()
            done.append((f"{folder}/{name}", records))

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(start, SLICE_ROWS).to_pylist():
                    if package is None:
                        name, records = f"{uuid.uuid4().hex}.wacz", 0
                        stream = system.open_output_stream(f"{inner}/{name}")
                        package = Package(stream)
                    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
                    digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
                    package.add(
                        row["page_id"], record(row["page_id"], row["url"], payload, digest, row["refers_to"], date)
                    )
                    records += 1
                    if package.at >= PACKAGE_BYTES:
                        finish()
                        package = None
        if package is not None:
            finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())],
            names=["path", "n_records"],
        )

    return with_originals(pages).mapInArrow(rows, "path string, n_records long")


def index(packages: DataFrame) -> DataFrame:
    """(path, page_id, offset, length) of every record of packages (path): offsets count from the file's start.

    The index is read by ranges; the central directory of a package is all else that is read.
    """

    def rows(columns: dict) -> dict:
        out = {"path": [], "page_id": [], "offset": [], "length": []}
        for path in columns["path"]:
            source = Source(path)
            lines, archive = _stored_member(source, INDEX), _stored_member(source, ARCHIVE)
            for line in source.read_at(lines.size, lines.start).decode().splitlines():
                entry = json.loads(line)
                out["path"].append(path)
                out["page_id"].append(entry["page_id"])
                out["offset"].append(archive.start + entry["offset"])
                out["length"].append(entry["length"])
        return out

    return exploded(packages.select("path"), rows, "path string, page_id long, offset long, length long")


_RECORD = (
    "page_id long, record_type string, record_id string, url string, payload_digest string, payload binary,"
    " refers_to_id string"
)


def read(entries: DataFrame) -> DataFrame:
    """The records at index entries (path, offset, length), any subset of an index, in tasks of bounded ranges.

    A revisit has no payload (null) and the id of the record it refers to.
    """

    def rows(columns: dict) -> dict:
        out: dict[str, list] = {n.strip().split(" ")[0]: [] for n in _RECORD.split(",")}
        places = sorted(zip(columns["path"], columns["offset"], columns["length"]))
        opened, source, held, held_at = None, None, b"", 0
        for path, offset, length in places:
            if path != opened:
                opened, source, held = path, Source(path), b""
            if not (held and held_at <= offset and offset + length <= held_at + len(held)):
                held, held_at = source.read_at(max(length, READ_BYTES), offset), offset
            headers, block = parsed(gzip.decompress(held[offset - held_at : offset - held_at + length]))
            response = headers["warc-type"] == "response"
            out["page_id"].append(int(headers["x-page-id"]) if "x-page-id" in headers else None)
            out["record_type"].append(headers["warc-type"])
            out["record_id"].append(headers["warc-record-id"])
            out["url"].append(headers.get("warc-target-uri"))
            out["payload_digest"].append(headers["warc-payload-digest"].removeprefix("sha1:"))
            out["payload"].append(block.partition(b"\r\n\r\n")[2] if response else None)
            out["refers_to_id"].append(headers.get("warc-refers-to"))
        return out

    split = F.expr(f"(path, offset DIV {TASK_RECORDS * 2048})")
    dealt = entries.select("path", "offset", "length").withColumn("part", split)
    return exploded(dealt.repartition("part").drop("part"), rows, _RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes and payload_digest of the full payload, record_type, refers_to (page_id)."""

    def rows(columns: dict) -> dict:
        sizes = [None if p is None else len(p) for p in columns["payload"]]
        same = [p is None or payload_digest(p) == d for p, d in zip(columns["payload"], columns["payload_digest"])]
        if not all(same):
            raise ValueError("a payload doesn't have its digest")
        return {n: columns[n] for n in ("page_id", "record_type", "record_id", "payload_digest", "refers_to_id")} | {
            "size": sizes
        }

    slim = exploded(
        records, rows, "page_id long, record_type string, record_id string, payload_digest string, refers_to_id string, size long"
    )
    slim = stored(slim, "records")
    of = slim.filter("record_type = 'response'").selectExpr(
        "record_id AS refers_to_id", "page_id AS refers_to", "size AS full_size"
    )
    return slim.join(of.dropDuplicates(["refers_to_id"]), "refers_to_id", "left").select(
        "page_id", F.coalesce("size", "full_size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to"
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes packages for the pages into the shared folder and reads them back, as ``resolved``."""
    packages = stored(written(pages, new_folder(pages.sparkSession, "warc")), "packages")
    return resolved(read(index(packages.repartition("path"))))
