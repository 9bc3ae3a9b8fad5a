"""The versioned table: commits, conflicts, replays, leases, kept views."""

import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from storyloom.functions import vectors
from storyloom.operators import analytics, ingest, versions
from storyloom.plans import corpus


@pytest.fixture()
def stories(spark, sf_dir):
    return corpus.load(spark, sf_dir, "stories").filter("story_id < 120")


def new_table(spark, path, rows, views=None, buckets=8):
    table = versions.VersionedTable(spark, f"file://{path}/table", buckets=buckets, views=views)
    table.create(rows)
    return table


def seen_again(stories, where, more=1):
    rows = stories.filter(where).withColumn("favorite_count", F.col("favorite_count") + more)
    return rows.drop("first_seen_at", "last_seen_at", "deleted_at", "summary_embedding")


def in_bucket(table, rows, b):
    return rows.filter(table.bucket() == b)


def test_a_batch_reads_and_writes_its_buckets_alone(spark, tmp_path, stories):
    table = new_table(spark, tmp_path, stories)
    before = table.version()
    batch = in_bucket(table, seen_again(stories, "true"), 3)
    read = []
    assert table.upsert(batch, lambda old, new: read.append(old.inputFiles()) or ingest.upsert_stories(old, new)) == [3]
    after = table.version()
    assert after.number == before.number + 1 and {b for b in after.buckets if after.buckets[b] != before.buckets[b]} == {"3"}
    assert read[0] and all("_bucket=3" in f for f in read[0])
    # a reader that opened the older version keeps it
    assert table.read(at=before).agg(F.sum("favorite_count")).first() == stories.agg(F.sum("favorite_count")).first()
    assert table.upsert(batch.limit(0), ingest.upsert_stories) == [] and table.version().number == after.number


def test_commits_on_other_buckets_stand_together_and_on_the_same_ones_start_anew(spark, tmp_path, stories):
    table = new_table(spark, tmp_path, stories)
    tries = []

    def slow(old, new, inner):
        """While this mutation runs, another writer commits `inner`."""
        tries.append(1)
        if len(tries) == 1:
            table.upsert(inner, ingest.upsert_stories)
        return ingest.upsert_stories(old, new)

    table.upsert(in_bucket(table, seen_again(stories, "true"), 1), lambda o, n: slow(o, n, in_bucket(table, seen_again(stories, "true"), 2)))
    assert len(tries) == 1 and table.version().number == 3
    tries.clear()
    table.upsert(in_bucket(table, seen_again(stories, "true", 5), 1), lambda o, n: slow(o, n, in_bucket(table, seen_again(stories, "true", 2), 1)))
    assert len(tries) == 2 and table.version().number == 5
    want = {r.story_id: r.favorite_count + {1: 5, 2: 1}.get(r.b, 0) for r in stories.select("*", table.bucket().alias("b")).collect()}
    assert {r.story_id: r.favorite_count for r in table.read().collect()} == want


def test_many_writers_at_once(spark, tmp_path, stories):
    table = new_table(spark, tmp_path, stories, buckets=2)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: table.upsert(seen_again(stories, f"story_id % 4 = {k}", 10 + k), ingest.upsert_stories), range(4)))
    assert {r.story_id: r.favorite_count for r in table.read().collect()} == {r.story_id: r.favorite_count + 10 + r.story_id % 4 for r in stories.collect()}
    assert table.version().number == 5
    with pytest.raises(versions.Conflict):
        table.create(stories)


def test_publish_is_exclusive(spark, tmp_path):
    path = f"file://{tmp_path}/log/1.json"
    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(lambda k: versions.publish(spark, path, f"writer {k}"), range(8))) == [False] * 7 + [True]
    assert spark.read.text(path).first()[0].startswith("writer ")
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("1.json.")]


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    schema = "surface_key string, last_page int, is_exhausted boolean, rows_ingested long, last_error string, seq int"
    rows = spark.createDataFrame([("a", 1, False, 25, None, 1), ("b", 1, False, 5, None, 1), ("a", 2, True, 10, None, 2)], schema)
    table = versions.VersionedTable(spark, f"file://{tmp_path}/table", "surface_key", 4)
    table.create(rows.drop("seq").limit(0))
    for number in (0, 1, 1, 0):
        table.upsert(rows, lambda o, n: ingest.record_progress(o, n, "seq"), "walk", number)
    table.upsert(rows.filter("surface_key = 'b'"), lambda o, n: ingest.record_progress(o, n, "seq"), "another", 0)
    table.upsert(rows.limit(0), lambda o, n: o, "walk", 7)
    assert sorted((r.surface_key, r.rows_ingested, r.last_page) for r in table.read().collect()) == [("a", 70, 2), ("b", 15, 1)]
    assert table.version().batches == {"walk": 7, "another": 0}


def test_leases_end_by_time_and_guard_the_write(spark, tmp_path, stories):
    table = new_table(spark, tmp_path, stories.withColumn("summary_embedding", F.lit(None).cast("array<float>")), buckets=4)
    assert table.claim("dead", [0, 1, 2, 3], until=100, now=0, most=3) == [0, 1, 2]
    assert table.claim("b", [0, 1, 2, 3], until=200, now=50, most=4) == [3]
    assert table.claim("b", [0, 1, 2, 3], until=200, now=100, most=4) == [0, 1, 2]
    late = vectors.embed_missing(in_bucket(table, table.read(), 0), dims=8)
    with pytest.raises(versions.Conflict):
        table.upsert(late, ingest.write_back, owner="dead", now=99)
    with pytest.raises(versions.Conflict):
        table.upsert(late, ingest.write_back, owner="b", now=300)
    assert table.upsert(late, ingest.write_back, owner="b", now=150) == [0]
    table.release("b", [0, 1, 2, 3])
    folders = versions.embed_claimed(table, "c", lambda rows: vectors.embed_missing(rows, dims=8), time.time, most=2)
    live = table.read().filter("deleted_at IS NULL")
    assert len(folders) == 2 and live.filter("summary_embedding IS NULL").count() == 0
    assert spark.read.parquet(*folders).count() == live.filter(table.bucket() > 0).count() and not table.version().leases


def test_kept_views_follow_every_batch(spark, tmp_path, sf_dir, stories):
    bridge, fandoms = corpus.load(spark, sf_dir, "story_fandoms"), corpus.load(spark, sf_dir, "fandoms")
    table = new_table(spark, tmp_path, stories, versions.story_counts(bridge, fandoms), buckets=4)

    def equal():
        now = table.read()
        assert sorted(map(tuple, versions.kept_facets(table).collect())) == sorted(map(tuple, analytics.facets(now, bridge, fandoms).collect()))
        assert versions.kept_stats(table).first() == analytics.stats(now).first()

    equal()
    # the only story of an author, the first and the last date, tombstones and their end
    first = stories.filter("deleted_at IS NULL").orderBy("published_at").first().story_id
    table.upsert(stories.filter(F.col("story_id") == first).select("story_id"), lambda old, new: old.join(new.withColumn("hit", F.lit(True)), "story_id", "left").withColumn("deleted_at", F.when(F.col("hit"), F.current_timestamp()).otherwise(F.col("deleted_at"))).drop("hit"))
    equal()
    table.upsert(seen_again(stories, f"story_id = {first} OR deleted_at IS NOT NULL").withColumn("genres", F.array(F.lit("Western"))), ingest.upsert_stories)
    equal()
    for k in range(8):
        table.upsert(seen_again(stories, f"story_id = {k}").withColumn("language", F.lit(f"l{k}")), ingest.upsert_stories)
    assert len(table.version().deltas) <= versions.MOST_DELTAS
    equal()
    assert table.vacuum(keep=1) > 0 and len(table.numbers()) == 1
    equal()


def test_rows_are_not_shuffled_to_be_written_to_few_buckets(spark, tmp_path, stories):
    for buckets, shuffled in ((8, False), (4096, True)):
        table = versions.VersionedTable(spark, f"file://{tmp_path}/dealt{buckets}", "story_id", buckets)
        assert ("hashpartitioning(_bucket" in table._dealt(stories.filter("story_id > 0"))._jdf.queryExecution().executedPlan().toString()) == shuffled
    few = versions.VersionedTable(spark, f"file://{tmp_path}/few", "story_id", 8)
    few.create(stories.repartition(3))
    assert few.read().count() == stories.count() and all(few.read([b]).filter(few.bucket() != b).count() == 0 for b in range(8))
