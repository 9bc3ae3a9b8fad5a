"""The stateful walk: any order of arrival, restarts, retries and their cap, missing pages, the stop of all surfaces."""

import random
from datetime import datetime

from pyspark.sql import Row
from pyspark.sql import functions as F
from storyloom.operators.versions import VersionedTable
from storyloom.operators.walk import walked
from storyloom.streaming import crawl, feeds

OUTCOME = "surface_key string, page_no int, outcome string, rows long, fetched_at timestamp"


class Crawl:
    """A feed folder and a table; each call of come() is a run of the stream over new outcomes."""

    def __init__(self, spark, path, start=None, **options):
        self.spark, self.path, self.start, self.options, self.n = spark, path, start, options, 0
        self.table = VersionedTable(spark, f"file://{path}/table", "surface_key", 2)
        self.table.create(spark.createDataFrame([], crawl.PROGRESS))

    def come(self, *rows):
        """Rows: surface, page, outcome, stories, second."""
        given = self.spark.createDataFrame([(s, p, o, n, t) for s, p, o, n, t in rows], OUTCOME.replace("timestamp", "long"))
        given.withColumn("fetched_at", F.timestamp_seconds("fetched_at")).coalesce(1).write.parquet(f"{self.path}/feed/run={self.n}")
        self.n += 1
        stream = feeds.file_stream(self.spark, f"{self.path}/feed/run=*", OUTCOME, 1)
        crawl.keep_progress(stream, f"{self.path}/mark", self.table, self.start, **self.options)
        return {r.surface_key: r for r in self.table.read().collect()}


def test_any_order_and_restarts_give_the_batch_walk(spark, tmp_path):
    log = [(f"s{s}", p, "error" if s == 1 and p == 4 else "ok", 0 if s == 2 and p == 6 else 25, 1000 + p) for s in range(4) for p in range(1, 11) if not (s == 3 and p == 5)]
    shuffled = log + log[::3]
    random.Random(5).shuffle(shuffled)
    run = Crawl(spark, tmp_path)
    for k in range(3):
        got = run.come(*shuffled[k::3])
    start = spark.createDataFrame([], "surface_key string, last_page int, is_exhausted boolean, rows_ingested long")
    want = walked(spark.createDataFrame([x[:4] for x in log], "surface_key string, page_no int, outcome string, rows long"), start).collect()
    assert {(r.surface_key, r.last_page, r.is_exhausted, r.rows_ingested, r.last_error) for r in got.values()} == {(r.surface_key, r.last_page, r.is_exhausted, r.rows_ingested, r.last_error) for r in want}
    assert got["s0"].last_page == 10 and got["s2"].is_exhausted and got["s3"].last_page == 4
    # the failed page comes after all: what waited behind it counts
    after = run.come(("s1", 4, "ok", 25, 1100), ("s3", 5, "ok", 7, 1100))
    assert (after["s1"].last_page, after["s1"].rows_ingested, after["s1"].last_error) == (10, 250, None)
    assert (after["s3"].last_page, after["s3"].rows_ingested) == (10, 232)


def test_attempts_are_capped_and_start_anew_after_cooling(spark, tmp_path):
    run = Crawl(spark, tmp_path, lateness="1 second", tries=2, backoff=10, cooling=1000)
    now = lambda t: F.timestamp_seconds(F.lit(t))
    due = lambda t: {tuple(r) for r in crawl.due(run.table.read(), now(t)).collect()}
    got = run.come(("a", 1, "server_error", 0, 100), ("b", 1, "ok", 25, 100), ("c", None, "ok", 25, 100), ("d", 1, None, None, 100))
    assert (got["a"].attempts, got["a"].last_error, got["d"].last_error, got["c"].last_page) == (1, "server_error", "unknown", 0)
    assert due(119) == {("b", 2), ("c", 1)} and due(120) == {("a", 1), ("b", 2), ("c", 1), ("d", 1)}
    got = run.come(("a", 1, "server_error", 0, 130))
    assert got["a"].attempts == 2 and ("a", 1) not in due(1129) and ("a", 1) in due(1130)
    got = run.come(("b", 2, "ok", 25, 2000))
    got = run.come(("b", 3, "ok", 25, 2001))
    assert got["a"].attempts == 0 and got["b"].rows_ingested == 75
    got = run.come(("a", 1, "ok", 25, 2002))
    assert (got["a"].last_page, got["a"].last_error, got["a"].next_try) == (1, None, None)


def test_missing_page_is_named_and_an_earlier_state_is_taken_over(spark, tmp_path):
    start = spark.createDataFrame([("a", 7, False, 170), ("e", 3, True, 50)], "surface_key string, last_page int, is_exhausted boolean, rows_ingested long")
    run = Crawl(spark, tmp_path, start, lateness="1 second", patience=60)
    got = run.come(("a", 8, "ok", 25, 100), ("a", 10, "ok", 25, 101), ("e", 4, "ok", 25, 100), ("a", 3, "ok", 25, 100))
    assert (got["a"].last_page, got["a"].rows_ingested, got["a"].missing_page) == (8, 195, None)
    assert (got["e"].last_page, got["e"].is_exhausted, got["e"].rows_ingested) == (3, True, 50)
    run.come(("z", 1, "ok", 25, 500))
    got = run.come(("z", 2, "ok", 25, 501))
    assert got["a"].missing_page == 9
    got = run.come(("a", 9, "ok", 25, 502))
    assert (got["a"].last_page, got["a"].missing_page) == (9, None)  # page 10 was forgotten and is asked for again
    assert {tuple(r) for r in crawl.due(run.table.read(), F.current_timestamp()).collect()} == {("a", 10), ("z", 3)}


def test_a_blocked_surface_stops_all_others(spark, tmp_path):
    run = Crawl(spark, tmp_path)
    run.come(("a", 1, "ok", 25, 100), ("b", 1, "blocked", 0, 101))
    later = F.current_timestamp()
    assert crawl.due(run.table.read(), later).count() == 0
    got = run.come(("b", 1, "ok", 25, 200))
    assert got["b"].rows_ingested == 25 and crawl.due(run.table.read(), later).count() == 2


class CountedState:
    """Stands for the handle and its value; counts the accesses."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, *_):  # noqa: N802
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.discard(at)


def test_a_surface_reads_and_writes_its_state_once_a_batch():
    held, own = CountedState(), crawl.Walk()
    own.init(held)
    come = lambda pages: list(own.handleInputRows(("a",), iter([Row(page_no=p, outcome="ok", rows=25, fetched_at=datetime.fromtimestamp(1000 + p)) for p in pages]), None))
    assert come(range(1000, 1, -1))[0].last_page == 0 and len(held.timers) == 1
    assert held.calls == 2
    assert tuple(come([1])[0])[:4] == ("a", 1000, False, 25_000) and not held.timers
    assert held.calls == 4
