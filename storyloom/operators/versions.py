"""A bucketed table behind a log of numbered commits, and views that the commits keep current.

Each commit is one small file that names, for every bucket, the folder that holds its rows, and the folders of the views'
signed counts. Publishing it is one atomic creation, so table and views become current together and readers keep the
version that they opened. Writers are optimistic: a batch reads and rewrites only the buckets that its keys fall into, and
one that finds its number taken moves past commits that touched other buckets and starts anew otherwise. There is no lock
to be left behind; leases on buckets expire by time. A commit may carry a stream's batch number, which makes a replayed
batch a no-op.

What passes the driver is bounded by the number of buckets, which is fixed for a table's life: choose it so that a bucket
is about a file's worth of rows."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.operators import analytics
from storyloom.operators.ingest import write_back
from storyloom.plans.corpus import AS_OF
from storyloom.schema import ABANDONED_YEARS

#: So many folders of view counts are summed into one.
MOST_DELTAS = 8
TRIES = 20
#: Files, at most, that a write may leave by not dealing its rows by bucket.
MOST_FILES = 4096


class Conflict(RuntimeError):
    """Another commit touched the same buckets, or took the lease."""


@dataclass(frozen=True)
class Version:
    """What one commit makes current."""

    number: int = 0
    schema: str = ""
    buckets: dict[str, str] = field(default_factory=dict)  # bucket to folder
    deltas: tuple[str, ...] = ()
    batches: dict[str, int] = field(default_factory=dict)  # stream to its last batch
    leases: dict[str, tuple[str, float]] = field(default_factory=dict)  # bucket to owner and end
    touched: tuple[str, ...] = ()  # buckets and streams that this commit wrote, read or leased


def _place(spark: SparkSession, path: str):
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole content, or returns False if there is one: by a hard link on a local file system, by a
    rename that never replaces on HDFS. (A store without either needs its own conditional write here.)"""
    draft = f"{path}.{uuid.uuid4().hex}"
    target, files = _place(spark, path)
    source, _ = _place(spark, draft)
    stream = files.create(source, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if files.getScheme() == "file":
        try:
            os.link(source.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            files.delete(source, False)
    done = not files.exists(target) and files.rename(source, target)
    if not done:
        files.delete(source, False)
    return done


class VersionedTable:
    """A table in hash buckets of `key`. views: what to count of rows, as view, value, n (see story_counts)."""

    def __init__(self, spark: SparkSession, root: str, key: str = "story_id", buckets: int = 256, views: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.root, self.key, self.buckets, self.views = spark, root.rstrip("/"), key, buckets, views

    # --- versions

    def numbers(self) -> list[int]:
        path, files = _place(self.spark, f"{self.root}/_log")
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def version(self, number: int | None = None) -> Version:
        """A version, by default the current one; the empty one before the first commit."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return Version()
        raw = json.loads(self.spark.read.text(f"{self.root}/_log/{number:012}.json", wholetext=True).first()[0])
        return Version(**raw | {"deltas": tuple(raw["deltas"]), "touched": tuple(raw["touched"]), "leases": {b: tuple(x) for b, x in raw["leases"].items()}})

    def commit(self, base: Version, change: Callable[[Version], Version], touched: set[str]) -> Version:
        """Publishes change(version) as the next version; if others came first, on top of theirs, or raises Conflict."""
        now = base
        while True:
            new = replace(change(now), number=now.number + 1, touched=tuple(sorted(touched)))
            if publish(self.spark, f"{self.root}/_log/{new.number:012}.json", json.dumps(asdict(new))):
                return new
            now = self.version(new.number)
            if touched & set(now.touched):
                raise Conflict(f"version {now.number} touched {sorted(touched & set(now.touched))[:5]}")

    # --- rows

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, only: list[int] | None = None, at: Version | None = None) -> DataFrame:
        """The rows of all buckets or of some, of the current version or of one that was read before."""
        at = at or self.version()
        if not at.schema:
            raise KeyError(f"{self.root} has no version yet")
        schema = T.StructType.fromJson(json.loads(at.schema))
        paths = [p for b, p in at.buckets.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """The rows with their bucket. Each task writes its own file to a bucket; only where these would be too many are
        whole rows shuffled by bucket first."""
        own = rows.withColumn("_bucket", self.bucket())
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return own if self.buckets * tasks <= MOST_FILES else own.repartition("_bucket")

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Writes rows to new folders, one per bucket; returns them."""
        path = f"{self.root}/rows/{uuid.uuid4().hex}"
        self._dealt(rows).write.partitionBy("_bucket").parquet(path)
        own, files = _place(self.spark, path)
        names = [s.getPath().getName() for s in files.listStatus(own)]
        return {n.split("=")[1]: f"{path}/{n}" for n in names if n.startswith("_bucket=")}

    def _delta(self, old: DataFrame | None, new: DataFrame, before: tuple[str, ...]) -> tuple[str, ...]:
        """Writes how the views' counts change, or the sums of all where many changes wait; returns the folders."""
        if self.views is None:
            return before
        plus = self.views(new)
        counts = plus if old is None else plus.unionByName(self.views(old).withColumn("n", -F.col("n")))
        path = f"{self.root}/views/{uuid.uuid4().hex}"
        many = len(before) >= MOST_DELTAS
        if many:
            counts = counts.unionByName(self._read_counts(before))
        counts.groupBy("view", "value").agg(F.sum("n").alias("n")).filter("n <> 0").write.parquet(path)
        return (path,) if many else (*before, path)

    def _read_counts(self, paths: tuple[str, ...]) -> DataFrame:
        return self.spark.read.schema("view string, value string, n long").parquet(*paths)

    def create(self, rows: DataFrame) -> Version:
        """The first version; Conflict if there is one."""
        base = self.version()
        if base.number:
            raise Conflict(f"{self.root} has version {base.number}")
        buckets = self._write(rows)
        new = self.spark.read.schema(rows.schema).parquet(*buckets.values()) if buckets else rows.limit(0)
        deltas = self._delta(None, new, ())
        return self.commit(base, lambda v: replace(v, schema=rows.schema.json(), buckets=buckets, deltas=deltas), set(map(str, range(self.buckets))))

    def upsert(self, batch: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, number: int = 0, owner: str | None = None, now: float = 0) -> list[int]:
        """Applies a mutation under which rows never go, such as upsert_stories, to the batch's buckets; returns these.

        stream, number: a micro-batch, applied once however often it is handed in. owner, now: the batch is written only
        where this owner's leases still hold, else Conflict."""
        wanted = batch.select(self.bucket().alias("b")).distinct()
        touched = sorted(r.b for r in wanted.collect())  # at most `buckets` numbers
        for _ in range(TRIES):
            base = self.version()
            if stream is not None and base.batches.get(stream, -1) >= number:
                return []
            for b in touched if owner is not None else ():
                held = base.leases.get(str(b))
                if not held or held[0] != owner or held[1] <= now:
                    raise Conflict(f"{owner} holds no lease on bucket {b}")
            if not touched:
                if stream is None:
                    return []
                folders, added = {}, ()
            else:
                old = self.read(touched, base)
                folders = self._write(apply(old, batch))
                new = self.spark.read.schema(old.schema).parquet(*folders.values())
                added = self._delta(old, new, base.deltas)

            def change(v: Version, folders=folders, added=added, base=base) -> Version:
                gone = set(base.deltas) - set(added) if added else set()
                deltas = tuple(d for d in v.deltas if d not in gone) + tuple(d for d in added if d not in base.deltas)
                return replace(v, buckets=v.buckets | folders, deltas=deltas, batches=v.batches | ({stream: number} if stream is not None else {}))

            try:
                # a sum of many changes replaces them, so it must not pass another one
                own = {*map(str, touched), *([f"stream:{stream}"] if stream is not None else []), *(["views"] if added and len(added) <= len(base.deltas) else [])}
                self.commit(base, change, own)
                return touched
            except Conflict:
                continue
        raise Conflict(f"no commit in {TRIES} tries")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what no kept version names: rows, counts, older commits. Returns the number of deleted folders. Run it
        while no writer is at work: what a writer has not published yet looks abandoned."""
        numbers = self.numbers()
        named = [self.version(n) for n in numbers[-keep:]]
        used = {p.rsplit("/", 1)[0] for v in named for p in v.buckets.values()} | {p for v in named for p in v.deltas}
        gone = 0
        for kind in ("rows", "views"):
            own, files = _place(self.spark, f"{self.root}/{kind}")
            for s in files.listStatus(own) if files.exists(own) else []:
                if f"{self.root}/{kind}/{s.getPath().getName()}" not in used:
                    files.delete(s.getPath(), True)
                    gone += 1
        for n in numbers[:-keep]:
            path, files = _place(self.spark, f"{self.root}/_log/{n:012}.json")
            files.delete(path, False)
        return gone

    # --- leases

    def claim(self, owner: str, wanted: list[int], until: float, now: float, most: int = 1) -> list[int]:
        """Leases up to `most` of the wanted buckets that nobody holds (or whose lease has ended); returns them."""
        for _ in range(TRIES):
            base = self.version()
            free = [b for b in wanted if base.leases.get(str(b), ("", 0))[1] <= now][:most]
            if not free:
                return []
            try:
                self.commit(base, lambda v, free=free: replace(v, leases=v.leases | {str(b): (owner, until) for b in free}), set(map(str, free)))
                return free
            except Conflict:
                continue
        return []

    def release(self, owner: str, held: list[int]) -> None:
        base = self.version()
        own = {str(b) for b in held if base.leases.get(str(b), ("", 0))[0] == owner}
        self.commit(base, lambda v: replace(v, leases={b: x for b, x in v.leases.items() if b not in own}), own)

    # --- views

    def counts(self, at: Version | None = None) -> DataFrame:
        """view, value, n of all that is counted now: no row of the table is read."""
        at = at or self.version()
        return self._read_counts(at.deltas).groupBy("view", "value").agg(F.sum("n").alias("n")).filter("n > 0")


def story_counts(story_fandoms: DataFrame, fandoms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What facets and statistics need of stories, as counts that add up: the facets; how many live stories have an author
    or a publication time, and when those in progress were updated; totals."""

    def counts(stories: DataFrame) -> DataFrame:
        rows = analytics.live(stories)

        def per(view: str, value: Column, where: Column | None = None) -> DataFrame:
            own = rows if where is None else rows.filter(where)
            return own.groupBy(F.lit(view).alias("view"), value.cast("string").alias("value")).agg(F.count("*").alias("n")).filter(F.col("value").isNotNull())

        def total(name: str, n: Column) -> DataFrame:
            return rows.agg(F.coalesce(n, F.lit(0)).cast("long").alias("n")).select(F.lit("total").alias("view"), F.lit(name).alias("value"), "n")

        facets = analytics.facets(stories, story_fandoms, fandoms).select(F.concat(F.lit("facet:"), "facet").alias("view"), "value", F.col("count").alias("n"))
        parts = [
            facets, per("author", F.col("author_id")), per("published", F.col("published_at")), per("in_progress", F.col("updated_at"), F.col("status") == "in_progress"),
            total("stories", F.count("*")), total("complete", F.count_if(F.col("status") == "complete")), total("with_ships", F.count_if(F.size("ships") > 0)),
            total("crossovers", F.count_if("is_crossover")), total("total_words", F.sum("word_count")),
        ]
        return reduce(DataFrame.unionByName, parts)

    return counts


def kept_facets(table: VersionedTable) -> DataFrame:
    """facets() from the kept counts."""
    own = table.counts().filter(F.col("view").startswith("facet:"))
    return own.select(F.substring("view", 7, 100).alias("facet"), "value", F.col("n").alias("count"))


def kept_stats(table: VersionedTable, as_of: str = AS_OF) -> DataFrame:
    """stats() from the kept counts; abandonment follows as_of, as the times of updates are counted."""
    view, value = F.col("view"), F.col("value")
    old = value.cast("timestamp") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{ABANDONED_YEARS}' YEAR")

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when((view == "total") & (value == name), F.col("n"))), F.lit(0)).alias(name)

    when = F.when(view == "published", value.cast("timestamp"))
    return table.counts().agg(
        total("stories"), F.count_if(view == "author").alias("authors"), total("complete"), F.coalesce(F.sum(F.when((view == "in_progress") & old, F.col("n"))), F.lit(0)).alias("abandoned"), total("with_ships"), total("crossovers"),
        total("total_words"), F.min(when).cast("date").alias("earliest"), F.max(when).cast("date").alias("latest"), F.lit(as_of).alias("computed_at"),
    )


def embed_claimed(table: VersionedTable, owner: str, embed: Callable[[DataFrame], DataFrame], clock: Callable[[], float], lease: float = 600, most: int = 4) -> list[str]:
    """An embedding worker: leases buckets that hold live stories without a vector, embeds those stories and writes them
    back under the lease, until no bucket is left that it can have. A worker that dies leaves leases that end by
    themselves; one whose lease was taken over meanwhile writes nothing. Returns the folders of the vectors it wrote."""
    out: list[str] = []
    while True:
        todo = table.read().filter(F.col("deleted_at").isNull() & F.col("summary_embedding").isNull())
        wanted = sorted(r.b for r in todo.select(table.bucket().alias("b")).distinct().collect())
        mine = table.claim(owner, wanted, clock() + lease, clock(), most)
        if not mine:
            return out
        path = f"{table.root}/embedded/{uuid.uuid4().hex}"
        embed(table.read(mine)).write.parquet(path)
        try:
            vectors = table.spark.read.schema("story_id long, summary_embedding array<float>").parquet(path)
            table.upsert(vectors, write_back, owner=owner, now=clock())
        except Conflict:
            continue
        table.release(owner, mine)
        out.append(path)
