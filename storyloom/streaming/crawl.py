"""The archive walk as keyed state with timers: what walk.walked() does to a finished log, for page outcomes as they come in.

Outcomes have surface_key, page_no, outcome, rows and fetched_at, their event time. Pages may come in any order and more
than once: a page ahead of a missing one waits in the surface's state, a page that is already counted changes nothing.
The state needs the RocksDB state store; with_state_store() sets it for the queries that are started inside."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from storyloom.operators.versions import VersionedTable
from storyloom.sources.surfaces import TRIES
from storyloom.streaming.feeds import run_available

PROGRESS = "surface_key string, last_page int, is_exhausted boolean, rows_ingested long, last_error string, attempts int, next_try timestamp, missing_page int"
_FIELDS = [x.strip().split(" ")[0] for x in PROGRESS.split(",")]
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNKNOWN = "unknown"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before)


class Walk(StatefulProcessor):
    """One surface. The next page, if it is good, moves last_page on; an empty one exhausts the surface for good; an error
    counts an attempt and sets next_try 2^attempts * `backoff` seconds later. After `tries` attempts at one page next_try
    is `cooling` seconds off, and when event time has passed it the attempts start anew. If a missing page has not come
    `patience` seconds after the first page that waits for it, the waiting pages are forgotten, as they will be fetched
    again, and missing_page names it.

    Rows without a page number are no pages; an outcome or row count that is null is the error `unknown`.

    A surface's progress and its waiting pages (at most an archive's) are one value, as each access to state is a call
    to the JVM: one read and one write for a surface and micro-batch, however many pages it brings."""

    def __init__(self, tries: int = TRIES, backoff: int = 60, patience: int = 3600, cooling: int = 86_400):
        self.tries, self.backoff, self.patience, self.cooling = tries, backoff, patience, cooling

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("surface", "last int, done boolean, rows long, error string, attempts int, next_try long, missing int, gap_at long, cool_at long, waiting string")

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        self._put((initialState["last_page"], initialState["is_exhausted"], initialState["rows_ingested"], None, 0, None, None, None, None), {})

    def _get(self) -> tuple[tuple, dict[int, tuple]]:
        """The surface's progress and its waiting pages: page to (rows, error, time)."""
        held = self.state.get()
        if held is None:
            return (0, False, 0, None, 0, None, None, None, None), {}
        *now, waiting = held
        return tuple(now), {page: tuple(x) for page, *x in json.loads(waiting)} if waiting else {}

    def _put(self, now: tuple, waiting: dict[int, tuple]) -> None:
        self.state.update((*now, json.dumps([(page, *x) for page, x in waiting.items()]) if waiting else None))

    def _shown(self, key: tuple, now: tuple) -> Row:
        last, done, rows, error, attempts, next_try, missing, *_ = now
        return Row(surface_key=key[0], last_page=last, is_exhausted=done, rows_ingested=rows, last_error=error, attempts=attempts, next_try=None if next_try is None else datetime.fromtimestamp(next_try / 1000), missing_page=missing)

    def _timers(self, old: set, new: set) -> None:
        for at in old - new - {None}:
            self.handle.deleteTimer(at)
        for at in new - old - {None}:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        old, waiting = self._get()
        last, done, total, error, attempts, next_try, missing, gap_at, cool_at = old
        pages = sorted(((int(x["page_no"]), x["fetched_at"].timestamp(), x["outcome"], x["rows"]) for x in rows if x["page_no"] is not None), key=lambda x: x[:2])
        for page, at, outcome, count in pages:
            ms = int(at * 1000)
            if done or page <= last:
                continue
            failed = None if outcome == "ok" and count is not None else outcome if outcome is not None and outcome != "ok" else UNKNOWN
            if page > last + 1:
                if failed is None or page not in waiting:  # an error stands for no page that came
                    waiting[page] = (0 if failed else int(count), failed, ms)
                    gap_at = gap_at or ms + 1000 * self.patience
                continue
            found = (0 if failed else int(count), failed, ms)
            while found is not None:
                n, failed, ms = found
                found = None
                if failed:
                    error, attempts = failed, attempts + 1
                    spent = attempts >= self.tries
                    next_try = ms + 1000 * (self.cooling if spent else self.backoff * 2**attempts)
                    cool_at = next_try if spent else cool_at
                    continue
                error, attempts, next_try, missing, cool_at = None, 0, None, None, None
                if n == 0:
                    done = True
                    continue
                last, total = last + 1, total + n
                found = waiting.pop(last + 1, None)
        if done:
            waiting.clear()
        if not waiting:
            gap_at = None
        self._timers({old[7], old[8]}, {gap_at, cool_at})
        new = (last, done, total, error, attempts, next_try, missing, gap_at, cool_at)
        self._put(new, waiting)
        yield self._shown(key, new)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now, waiting = self._get()
        last, done, total, error, attempts, next_try, missing, gap_at, cool_at = now
        if gap_at == at:
            waiting.clear()
            gap_at, missing = None, last + 1
        if cool_at == at:
            attempts, cool_at = 0, None
        new = (last, done, total, error, attempts, next_try, missing, gap_at, cool_at)
        self._put(new, waiting)
        yield self._shown(key, new)

    def close(self) -> None:
        pass


def walk(outcomes: DataFrame, start: DataFrame | None = None, lateness: str = "1 day", **options: int) -> DataFrame:
    """A row of PROGRESS whenever a surface changes; `start` holds the rows of an earlier crawl state, one a surface.
    Outcomes later than `lateness` behind the newest are dropped, so their pages are fetched again."""
    events = outcomes.select("surface_key", "page_no", "outcome", "rows", F.col("fetched_at").cast("timestamp")).withWatermark("fetched_at", lateness)
    initial = None if start is None else start.select("surface_key", F.coalesce("last_page", F.lit(0)).cast("int").alias("last_page"), F.coalesce("is_exhausted", F.lit(False)).alias("is_exhausted"), F.coalesce("rows_ingested", F.lit(0)).cast("long").alias("rows_ingested")).groupBy("surface_key")
    return events.groupBy("surface_key").transformWithState(Walk(**options), PROGRESS, "Update", "EventTime", initial)


def newest(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of the batch stand for those of their surface; of several in a batch, that of the furthest state."""
    order = F.struct("last_page", "is_exhausted", F.coalesce("missing_page", F.lit(0)), F.coalesce("attempts", F.lit(0)))
    rows = batch.groupBy("surface_key").agg(F.max_by(F.struct(*_FIELDS[1:]), order).alias("x")).select("surface_key", "x.*")
    return rows.unionByName(old.join(rows.select("surface_key"), "surface_key", "left_anti"))


def keep_progress(outcomes: DataFrame, checkpoint: str, table: VersionedTable, start: DataFrame | None = None, name: str = "walk", **options) -> None:
    """Walks all outcomes that are there and commits the surfaces' rows to the table, each micro-batch once."""

    def commit(batch: DataFrame, number: int) -> None:
        held = batch.persist()  # upsert() reads a batch more than once, and each reading would walk anew
        try:
            table.upsert(held, newest, name, number)
        finally:
            held.unpersist()

    with with_state_store(table.spark):
        run_available(walk(outcomes, start, **options), checkpoint, commit, "update")


def due(progress: DataFrame, now: Column) -> DataFrame:
    """(surface_key, page_no): the page to fetch of each surface that is not exhausted and whose next_try has come. None
    at all while a surface is blocked: a 403 stops the whole crawl, until that surface's page has come or its row is
    cleared by hand."""
    stopped = progress.agg(F.coalesce(F.max(F.col("last_error") == "blocked"), F.lit(False)).alias("stopped"))  # one row
    open_ = progress.filter(~F.col("is_exhausted") & (F.col("next_try").isNull() | (F.col("next_try") <= now)))
    return open_.crossJoin(F.broadcast(stopped)).filter(~F.col("stopped")).select("surface_key", (F.col("last_page") + 1).alias("page_no"))
