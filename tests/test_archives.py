"""The archive source: pages come back whole, streams follow growing archives, torn writes and filters."""

import os
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from storyloom.sources import archives
from storyloom.streaming import feeds

AT = datetime(2024, 5, 1, 12, 30, 0, 123456, tzinfo=timezone.utc)


def fields(rows):
    return sorted((r.surface_key or "", r.page_no, r.html) for r in rows)


def test_written_pages_come_back_with_nulls_and_long_texts(spark, tmp_path):
    root = f"file://{tmp_path}/a"
    given = [("s1", 1, AT, "<p>ü\u2028"), ("s1", 2, None, None), (None, None, AT, "x" * 9_000_000), ("s2", 1, AT, ""), ("s1", 1, AT, "<p>ü\u2028")]
    pages = spark.createDataFrame(given, archives.SCHEMA).repartition(3)
    archives.write_pages(pages, root)
    archives.write_pages(pages.limit(0), root)
    got = archives.read_archives(spark, root)
    key = lambda r: (r[0] or "", r[1] or 0, r[2] is not None, r[3] or "")
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r) for r in pages.collect()), key=key)
    assert not [x for x in os.listdir(tmp_path / "a") if x.startswith(".")]
    with pytest.raises(Exception, match="only appended"):
        pages.write.format(archives.NAME).mode("overwrite").save(root)


def test_the_sink_takes_arrow_batches_of_any_size(tmp_path, monkeypatch):
    """Pages become Python values a few at a time, in order."""
    monkeypatch.setattr(archives.TaskContext, "get", lambda: type("Task", (), {"partitionId": lambda self: 3})())
    sink = archives.ArchiveSink({"path": str(tmp_path)}, False)
    batches = [pa.RecordBatch.from_pylist([{"surface_key": f"s{k}", "page_no": k, "fetched_at": AT, "html": f"<p>{k}"} for k in part], archives.ARROW) for part in (range(130), range(0), range(130, 131))]
    sink.commit([sink.write(iter(batches)), None])
    part = archives.Pages("batch-00003", 0, 0, 131)
    got = [r for b in archives.read_pages(str(tmp_path), part, None) for r in b.to_pylist()]
    assert got == [r for b in batches for r in b.to_pylist()]


def test_missing_folder_is_empty_and_other_stores_are_refused(spark, tmp_path):
    assert archives.read_archives(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="mounted file system"):
        archives.read_archives(spark, "s3a://bucket/x").count()


def test_asked_surfaces_are_read_alone(spark, tmp_path):
    root = str(tmp_path)
    with archives.ArchiveWriter(root, "w") as out:
        for k in range(60):
            out.append(f"s{k % 3}", k, f"<p>{k}", AT)
    # the pages of another surface are unreadable: a scan that meets them fails
    first = archives.archive(root, "w", 0)
    entries = list(archives.ENTRY.iter_unpack(open(archives.archive(root, "w", 0, "index"), "rb").read()))
    with open(first, "r+b") as file:
        for place, length, surface in entries:
            if surface == archives.surface_hash("s2"):
                file.seek(place)
                file.write(b"\0" * length)
    assert sorted(r.page_no for r in archives.read_archives(spark, root, ["s1"]).collect()) == list(range(1, 60, 3))
    assert archives.read_archives(spark, root, ["s0", "s1", "none"]).filter("page_no < 6").count() == 4
    assert archives.read_archives(spark, root, []).count() == 0
    with pytest.raises(Exception):
        archives.read_archives(spark, root).collect()


def test_one_loaded_frame_answers_different_filters(spark, tmp_path):
    with archives.ArchiveWriter(str(tmp_path), "w") as out:
        for k in range(30):
            out.append(f"s{k % 3}", k, "<p>")
    got = archives.read_archives(spark, str(tmp_path))
    assert [got.filter(f"surface_key = 's{k}'").count() for k in (0, 1, 5)] == [10, 10, 0]
    assert got.count() == 30


def test_ranges_cover_every_page_once_across_closed_archives(tmp_path):
    root = str(tmp_path)
    with archives.ArchiveWriter(root, "w", roll_bytes=300) as out:
        for k in range(50):
            out.append("s", k, os.urandom(40).hex())
    end = archives.ends(root)
    assert end["w"][0] > 3
    whole = archives.between(root, {}, end, 3)
    seen = [n for p in whole for b in archives.read_pages(root, p, None) for n in b.column(1).to_pylist()]
    assert seen == list(range(50))
    number, page = whole[7].number, whole[7].first
    rest = archives.between(root, {"w": [number, page]}, end, 1000)
    tail = [n for p in rest for b in archives.read_pages(root, p, None) for n in b.column(1).to_pylist()]
    assert tail == seen[len(seen) - len(tail) :] and 0 < len(tail) < 50


def test_a_writer_that_died_half_way_loses_no_whole_page(spark, tmp_path):
    root = str(tmp_path)
    with archives.ArchiveWriter(root, "w") as out:
        out.append("s", 1, "<p>one")
    with open(archives.archive(root, "w", 0), "ab") as file:
        file.write(b"half a page")
    with open(archives.archive(root, "w", 0, "index"), "ab") as file:
        file.write(b"1234567")
    assert fields(archives.read_archives(spark, root).collect()) == [("s", 1, "<p>one")]
    with archives.ArchiveWriter(root, "w") as out:
        out.append("s", 2, "<p>two")
    assert fields(archives.read_archives(spark, root).collect()) == [("s", 1, "<p>one"), ("s", 2, "<p>two")]


def test_stream_resumes_from_its_offset_while_archives_grow(spark, tmp_path):
    root, sink, mark = str(tmp_path / "a"), str(tmp_path / "sink"), str(tmp_path / "mark")

    def run():
        feeds.run_available(archives.stream_archives(spark, root), mark, lambda batch, n: batch.write.parquet(f"{sink}/n={n}"))

    one, two = archives.ArchiveWriter(root, "one", roll_bytes=200), archives.ArchiveWriter(root, "two")
    want = []
    for turn in range(3):
        for k in range(10):
            for out in (one, two)[: 1 + (turn + k) % 2]:
                page = turn * 10 + k
                out.append(out.writer, page, f"<p>{page}")
                want.append((out.writer, page, f"<p>{page}"))
        run()
    run()  # nothing new
    got = spark.read.parquet(sink)
    assert got.select("n").distinct().count() == 3
    assert fields(got.collect()) == sorted(want)
    assert got.groupBy("n").agg(F.count("*").alias("c")).orderBy("n").first().c == 15
