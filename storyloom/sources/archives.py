"""Archives of fetched listing pages as the data source `listing_archive`, for batches, streams and writes.

A crawler appends each page to its own archive as soon as it is fetched. Spark's file streams take a file once, when it is
complete; this source follows archives that grow, page by page.

The layout is root/writer/00000000.pages with 00000000.index beside it. A page is a compressed block of its own; its
index entry, of fixed length, is written after it. So a reader knows the number of whole pages by the index's length,
a page whose writer died half-way does not exist, and a task range-reads its pages alone. An archive that has reached
ROLL_BYTES is closed by the next number. An offset is (archive, pages) a writer: it grows with the writers, not with the
pages. Workers read with plain file calls, so root must lie on a file system that driver and executors have mounted."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from storyloom.functions.listing import listing_rows, with_context

NAME = "listing_archive"
SCHEMA = "surface_key string, page_no int, fetched_at timestamp, html string"
ARROW = pa.schema([("surface_key", pa.string()), ("page_no", pa.int32()), ("fetched_at", pa.timestamp("us", tz="UTC")), ("html", pa.string())])
#: place of the page in the archive, its length there, hash of its surface
ENTRY = struct.Struct("<QQQ")
#: zlib's: on the test tables' texts 2.5 times as fast as its default 6, with 5% more bytes
LEVEL = 3
ROLL_BYTES = 128 << 20
PAGES_PER_TASK = 1024
BATCH_BYTES = 8 << 20


def mounted(path: str) -> str:
    """The path for plain file calls."""
    scheme, found, rest = path.partition(":")
    if found and "/" not in scheme:
        if scheme != "file":
            raise ValueError(f"{path}: archives are read from a mounted file system, not from {scheme}")
        return "/" + rest.lstrip("/")
    return path


def surface_hash(surface_key: str | None) -> int:
    return int.from_bytes(hashlib.blake2b((surface_key or "").encode(), digest_size=8).digest(), "little")


def numbers(folder: str) -> list[int]:
    """The archives of a writer, in order."""
    return sorted(int(x.removesuffix(".index")) for x in os.listdir(folder) if x.endswith(".index"))


def archive(root: str, writer: str, number: int, kind: str = "pages") -> str:
    return os.path.join(root, writer, f"{number:08d}.{kind}")


def pages_in(root: str, writer: str, number: int) -> int:
    return os.path.getsize(archive(root, writer, number, "index")) // ENTRY.size


class ArchiveWriter:
    """Appends pages as one writer; one process at a time may do so under a name. After a crash the next page follows
    what is whole."""

    def __init__(self, root: str, writer: str, roll_bytes: int = ROLL_BYTES, durable: bool = True):
        self.root, self.writer, self.roll_bytes, self.durable = mounted(root), writer, roll_bytes, durable
        os.makedirs(os.path.join(self.root, writer), exist_ok=True)
        self._open(max(numbers(os.path.join(self.root, writer)), default=0))

    def _open(self, number: int) -> None:
        self.number = number
        self.data = open(archive(self.root, self.writer, number), "ab")
        self.index = open(archive(self.root, self.writer, number, "index"), "ab")
        self.index.truncate(self.index.tell() // ENTRY.size * ENTRY.size)

    def append(self, surface_key: str | None, page_no: int | None, html: str | None, fetched_at: datetime | None = None) -> None:
        if self.data.tell() >= self.roll_bytes:
            self.close()
            self._open(self.number + 1)
        place = self.data.tell()
        body = zlib.compress(json.dumps([surface_key, page_no, fetched_at and fetched_at.astimezone(timezone.utc).isoformat(), html]).encode(), LEVEL)
        self.data.write(body)
        if self.durable:
            self.data.flush()
            os.fsync(self.data.fileno())
        self.index.write(ENTRY.pack(place, len(body), surface_hash(surface_key)))
        if self.durable:
            self.index.flush()

    def close(self) -> None:
        for file in (self.data, self.index):
            file.flush()
            os.fsync(file.fileno())
            file.close()

    def __enter__(self) -> ArchiveWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()


@dataclass
class Pages(InputPartition):
    """Pages first to last, without last, of one archive."""

    writer: str
    number: int
    first: int
    last: int


def ends(root: str) -> dict[str, list[int]]:
    """What there is now: of each writer the last archive and its number of pages."""
    if not os.path.isdir(root):
        return {}
    found = {}
    for writer in sorted(x.name for x in os.scandir(root) if x.is_dir() and not x.name.startswith((".", "_"))):
        held = numbers(os.path.join(root, writer))
        if held:
            found[writer] = [held[-1], pages_in(root, writer, held[-1])]
    return found


def between(root: str, start: dict[str, list[int]], end: dict[str, list[int]], pages_per_task: int) -> list[Pages]:
    """The pages from one offset to another, by archive and in ranges of pages."""
    out = []
    for writer, (last_number, last_page) in end.items():
        from_number, from_page = start.get(writer, [0, 0])
        for number in (x for x in numbers(os.path.join(root, writer)) if from_number <= x <= last_number):
            stop = last_page if number == last_number else pages_in(root, writer, number)
            first = from_page if number == from_number else 0
            out += [Pages(writer, number, k, min(k + pages_per_task, stop)) for k in range(first, stop, pages_per_task)]
    return out


def read_pages(root: str, part: Pages, surfaces: set[str] | None) -> Iterator[pa.RecordBatch]:
    with open(archive(root, part.writer, part.number, "index"), "rb") as index:
        index.seek(part.first * ENTRY.size)
        entries = list(ENTRY.iter_unpack(index.read((part.last - part.first) * ENTRY.size)))
    wanted = None if surfaces is None else {surface_hash(x) for x in surfaces}
    rows, held = [], 0
    with open(archive(root, part.writer, part.number), "rb") as data:
        for place, length, surface in entries:
            if wanted is not None and surface not in wanted:
                continue
            data.seek(place)
            key, page_no, fetched_at, html = json.loads(zlib.decompress(data.read(length)))
            if surfaces is not None and key not in surfaces:
                continue
            rows.append((key, page_no, fetched_at and datetime.fromisoformat(fetched_at), html))
            held += len(html or "")
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class _Root:
    def __init__(self, options: dict):
        self.root, self.pages_per_task = mounted(options["path"]), int(options.get("pagespertask", PAGES_PER_TASK))
        self.surfaces = set(json.loads(options["surfaces"])) if "surfaces" in options else None

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else read_pages(self.root, partition, self.surfaces)  # None: no partitions


class ArchiveReader(_Root, DataSourceReader):
    # no pushFilters(): what one query of a loaded DataFrame pushes stays with that DataFrame's other queries
    def partitions(self) -> list[Pages]:
        return between(self.root, {}, ends(self.root), self.pages_per_task)


class ArchiveStream(_Root, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return ends(self.root)

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        return between(self.root, start, end, self.pages_per_task)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    writer: str
    count: int


class ArchiveSink(DataSourceArrowWriter):
    """Each task stages an archive of its own; those of the attempts that count become the next archives of their
    writers, named by the option `writer` and the task's number, when the job commits. Two jobs at a time need two
    names. A driver that dies while it commits leaves a part of the archives visible."""

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("archives are only appended to")
        self.root, self.name = mounted(options["path"]), options.get("writer", "batch")
        self.staging = f".staged-{uuid.uuid4().hex}"

    def write(self, iterator) -> Staged:
        folder = os.path.join(self.root, self.staging)
        name = uuid.uuid4().hex
        count = 0
        with ArchiveWriter(folder, name, roll_bytes=1 << 62, durable=False) as out:
            for batch in iterator:
                for k in range(0, batch.num_rows, 64):  # no more pages at a time as Python values
                    part = batch.slice(k, 64)
                    for row in zip(*(part.column(part.schema.get_field_index(x)).to_pylist() for x in ("surface_key", "page_no", "html", "fetched_at")), strict=True):
                        out.append(*row)
                        count += 1
        return Staged(os.path.join(folder, name), f"{self.name}-{TaskContext.get().partitionId():05d}", count)

    def commit(self, messages) -> None:
        for x in messages:
            if x is None or not x.count:
                continue
            target = os.path.join(self.root, x.writer)
            os.makedirs(target, exist_ok=True)
            number = max(numbers(target), default=-1) + 1
            for kind in ("pages", "index"):  # the index last: it makes the archive visible
                os.rename(os.path.join(x.folder, f"{0:08d}.{kind}"), archive(self.root, x.writer, number, kind))
        self._clear()

    def abort(self, messages) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(os.path.join(self.root, self.staging), ignore_errors=True)


class ListingArchive(DataSource):
    """Options: path; for readers pagesPerTask and surfaces, a JSON list of keys that are met in the index, so that other
    pages are not read; for writes writer."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveSink:
        return ArchiveSink(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(ListingArchive)
    return spark


def write_pages(pages: DataFrame, root: str, writer: str = "batch") -> None:
    """Appends surface_key, page_no, fetched_at and html of all rows; no other columns."""
    register(pages.sparkSession)
    pages.select("surface_key", F.col("page_no").cast("int"), F.col("fetched_at").cast("timestamp"), "html").write.format(NAME).option("writer", writer).mode("append").save(root)


def read_archives(spark: SparkSession, root: str, surfaces: Sequence[str] | None = None) -> DataFrame:
    found = register(spark).read.format(NAME)
    return (found if surfaces is None else found.option("surfaces", json.dumps(list(surfaces)))).load(root)


def stream_archives(spark: SparkSession, root: str, surfaces: Sequence[str] | None = None) -> DataFrame:
    found = register(spark).readStream.format(NAME)
    return (found if surfaces is None else found.option("surfaces", json.dumps(list(surfaces)))).load(root)


def stories_of(pages: DataFrame, names: Column | None = None) -> DataFrame:
    """Story rows of archived pages, with the surface, page and time they come from; `names` are the fandoms of a page's
    surface, for rows without their own."""
    rows = listing_rows(pages)
    return rows if names is None else with_context(rows, names)
