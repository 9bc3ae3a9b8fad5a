"""WARC records in ZIP-packaged archives: a writer, and a reader that never unpacks an archive.

An archive is a ZIP file of stored members: archive/data.warc.gz, one gzip member per record, and indexes/index.cdxj with
each record's place. The reader finds the end record, follows the ZIP64 locator where there is one, parses the central
directory, locates the members' data behind their local headers, and reads records by byte ranges, neighbours together.

Archives are written by tasks into the shared folder under names of their own, then listed in a manifest table: what a
lost or repeated task leaves behind is not in the manifest. A task holds one archive of about ARCHIVE_BYTES.

Null html counts as an empty payload, a null url leaves the target out. Each row gets a record, repeated ids too. Of equal
payloads of LEAST bytes or more the smallest id is the response; rows with a null id never are, unless no row has one.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_uri, local_path, new_path, slices, stored

LEAST, ARCHIVE_BYTES, READ_BYTES = 100, 16 << 20, 1 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-06-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
BIG16, BIG32 = 0xFFFF, 0xFFFFFFFF


# --- files in a local or remote store


def write_file(uri: str, data: bytes) -> None:
    """Writes under another name first, so that a file is whole or absent."""
    path = local_path(uri)
    if path:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)
        return
    store, path = fs.FileSystem.from_uri(arrow_uri(uri))
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


class RangeFile:
    """Byte ranges of a file; `reads` counts what was fetched."""

    def __init__(self, uri: str):
        path = local_path(uri)
        if path:
            self.file = pa.OSFile(path, "rb")
        else:
            store, path = fs.FileSystem.from_uri(arrow_uri(uri))
            self.file = store.open_input_file(path)
        self.size, self.reads = self.file.size(), 0

    def read(self, start: int, length: int) -> bytes:
        if start < 0 or length < 0 or start + length > self.size:
            raise ValueError("the range is outside the file")
        self.file.seek(start)
        self.reads += length
        return self.file.read(length)

    def close(self) -> None:
        self.file.close()


# --- ZIP


def zip_stored(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; with ZIP64 records where sizes need them, or always."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, crc = name.encode(), len(out), zlib.crc32(data)
        big = zip64 or len(data) >= BIG32 or at >= BIG32
        size = BIG32 if big else len(data)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data)) if big else b""
        version = 45 if big else 20
        out += LOCAL + struct.pack("<HHHHHIIIHH", version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, len(data), len(data), at) if big else b""
        central += CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", version, version, 0x800, 0, 0, 0x21, crc, size, size, len(raw), len(extra), 0, 0, 0, 0, BIG32 if big else at) + raw + extra
    start, n = len(out), len(members)
    out += central
    big = zip64 or n >= BIG16 or start >= BIG32 or len(central) >= BIG32
    if big:
        at = len(out)
        out += END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(central), start)
        out += LOCATOR + struct.pack("<IQI", 0, at, 1)
    out += END + struct.pack("<HHHHIIH", 0, 0, BIG16 if big else n, BIG16 if big else n, BIG32 if big else len(central), BIG32 if big else start, 0)
    return bytes(out)


class ZipDirectory:
    """The members of a ZIP file by name: (offset of the local header, packed size, size, method, crc)."""

    def __init__(self, file: RangeFile):
        self.file = file
        tail_at = max(0, file.size - 22 - BIG16)
        tail = file.read(tail_at, file.size - tail_at)
        k = tail.rfind(END)
        while k >= 0 and (k + 22 > len(tail) or k + 22 + struct.unpack_from("<H", tail, k + 20)[0] != len(tail)):
            k = tail.rfind(END, 0, k)
        if k < 0:
            raise ValueError("no ZIP end record")
        _, _, _, n, size, start = struct.unpack_from("<HHHHII", tail, k + 4)
        end = tail_at + k
        if end >= 20 and (locator := file.read(end - 20, 20))[:4] == LOCATOR:
            at = struct.unpack_from("<Q", locator, 8)[0]
            record = file.read(at, 56)
            if record[:4] != END64:
                raise ValueError("the ZIP64 locator leads to no ZIP64 end record")
            n, size, start = struct.unpack_from("<QQQ", record, 32)
        elif BIG16 == n or BIG32 in (size, start):
            raise ValueError("a ZIP64 end record is missing")
        raw, at = file.read(start, size), 0
        self.members: dict[str, tuple[int, int, int, int, int]] = {}
        for _ in range(n):
            if raw[at : at + 4] != CENTRAL:
                raise ValueError("the central directory is damaged")
            flags, method, _, _, crc, packed, full, name_n, extra_n, comment_n, _, _, _, offset = struct.unpack_from("<HHHHIIIHHHHHII", raw, at + 8)
            name = raw[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, k = raw[at + 46 + name_n : at + 46 + name_n + extra_n], 0
            while k + 4 <= len(extra):
                kind, length = struct.unpack_from("<HH", extra, k)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", extra, k + 4))
                    full = next(wide) if full == BIG32 else full
                    packed = next(wide) if packed == BIG32 else packed
                    offset = next(wide) if offset == BIG32 else offset
                k += 4 + length
            self.members[name] = (offset, packed, full, method, crc)
            at += 46 + name_n + extra_n + comment_n

    def start(self, name: str) -> int:
        """Where a stored member's data begin."""
        offset, _, _, method, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is not stored")
        head = self.file.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError(f"{name} has no local header")
        return offset + 30 + sum(struct.unpack_from("<HH", head, 26))

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member; a whole one is checked against its CRC."""
        size = self.members[name][2]
        if start < 0 or start + (length or 0) > size:
            raise ValueError("the range is outside the member")
        data = self.file.read(self.start(name) + start, size - start if length is None else length)
        if length is None and not start and zlib.crc32(data) != self.members[name][4]:
            raise ValueError(f"{name} is damaged")
        return data


# --- WARC


def _header_value(x: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", x)


def warc_record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response with its payload, or, with refers_to, a revisit without it. Both keep the HTTP header, and so the
    payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id if page_id is not None else ''}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The named fields of a record (lower-case names) and its block."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut off")
    return fields, rest[:n]


def _urn(x: str) -> int | None:
    found = x.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def read_archive(uri: str, wanted: Callable[[dict], bool] | None = None) -> Iterator[dict]:
    """The records of an archive, by ranges: all, or those whose index entry is wanted."""
    file = RangeFile(uri)
    try:
        zipped = ZipDirectory(file)
        entries = [json.loads(line.split(b" ", 1)[1]) for line in zipped.read(INDEX).splitlines()]
        entries = [e for e in entries if wanted is None or wanted(e)]
        at = 0
        while at < len(entries):
            start, end, last = entries[at]["offset"], entries[at]["offset"] + entries[at]["length"], at + 1
            while last < len(entries) and entries[last]["offset"] == end and end + entries[last]["length"] - start <= READ_BYTES:
                end += entries[last]["length"]
                last += 1
            data = zipped.read(DATA, start, end - start)
            for e in entries[at:last]:
                fields, block = parse_record(gzip.decompress(data[e["offset"] - start : e["offset"] - start + e["length"]]))
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)\r\ncontent-length: *(\d+)", http + b"\r\n")[1])
                kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                refers = fields.get("warc-refers-to")
                yield {"page_id": _urn(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": _urn(refers) if refers else None, "payload": payload if kind == "response" else None}
            at = last
    finally:
        file.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes a record per row and returns the stored manifest: path, records, bytes.

    Pages meet only the smallest id of payloads that several rows share; a hot payload's rows are split by the adaptive
    skew join."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    shared = rows.filter(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    planned = rows.join(shared, "digest", "left").withColumn("refers", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index = bytearray(), []

        def flush() -> pa.RecordBatch:
            uri = f"{folder}/{uuid.uuid4().hex}.wacz"
            whole = zip_stored([(DATA, bytes(data)), (INDEX, b"\n".join(index))], zip64)
            write_file(uri, whole)
            told = pa.record_batch({"path": [uri], "records": pa.array([len(index)], pa.int64()), "bytes": pa.array([len(whole)], pa.int64())})
            data.clear()
            index.clear()
            return told

        for batch in batches:
            for part in slices(batch, "html"):
                for page, url, text, digest, refers in zip(*(part.column(k).to_pylist() for k in ("page_id", "url", "html", "digest", "refers")), strict=True):
                    packed = gzip.compress(warc_record(page, url, text.encode(), digest, refers), 1, mtime=0)
                    entry = {"page": page, "offset": len(data), "length": len(packed), "type": "response" if refers is None else "revisit", "digest": digest}
                    index.append(f"{page} {json.dumps(entry)}".encode())
                    data.extend(packed)
                    if len(data) >= archive_bytes:
                        yield flush()
        if index:
            yield flush()

    manifest = planned.select("page_id", "url", "html", "digest", "refers").mapInArrow(work, "path string, records long, bytes long")
    return stored(manifest, "manifest")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to and,
    if asked for, the responses' payload. A task reads whole archives, which are of bounded size."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for row in read_archive(path):
                    rows.append(row if with_payload else row | {"payload": None})
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    paths = manifest.select("path")
    return paths.repartition(max(1, min(paths.count(), 1 << 16))).mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_folder(spark) -> str:
    return new_path(spark, "warc")
