"""Idempotent ingestion: each mutation is a pure function from the old rows and a batch to the new rows.

Session-catalog Parquet has no MERGE or UPDATE; VersionedTable applies these functions to the buckets of a batch."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.plans.corpus import AS_OF
from storyloom.schema import STALE_DAYS

#: What an update overwrites; the other columns keep their stored values.
OVERWRITTEN = (
    "title", "author_name", "summary", "rating", "language", "genres", "characters", "ships", "chapter_count", "word_count", "review_count",
    "favorite_count", "follow_count", "status", "updated_at", "cover_image_id",
)
KEPT = ("author_id", "is_crossover", "published_at", "first_seen_at")


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no frame has such a column."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def last_wins(batch: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One row per key: the last by `order` (a batch without an order must have unique keys)."""
    if order is None:
        return batch
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    place = free_name("_n", batch)
    return batch.withColumn(place, F.row_number().over(w)).filter(F.col(place) == 1).drop(place, order)


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key other rows have as well; keys are counted map-side."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*keys)
    return rows.join(twice, keys, "left_semi")


def upsert_stories(stories: DataFrame, batch: DataFrame, now: str = AS_OF, order: str | None = None) -> DataFrame:
    """New snapshot of the stories. A changed summary drops the embedding; a seen story loses its tombstone. One full
    join on story_id: with both sides bucketed by it, nothing is shuffled. An empty batch changes nothing."""
    new = last_wins(batch, ["story_id"], order)
    at = F.lit(now).cast("timestamp")
    mark = free_name("_mark", stories, new)
    old, fresh = stories.withColumn(mark, F.lit(True)).alias("o"), new.withColumn(mark, F.lit(True)).alias("n")
    seen, known = F.col(f"n.{mark}").isNotNull(), F.col(f"o.{mark}").isNotNull()
    out = []
    for field in stories.schema.fields:
        c = field.name
        if c == "story_id":
            value = F.coalesce(F.col("o.story_id"), F.col("n.story_id"))
        elif c == "last_seen_at":
            value = F.when(seen, at).otherwise(F.col(f"o.{c}"))
        elif c == "first_seen_at":
            value = F.when(known, F.col(f"o.{c}")).otherwise(at)
        elif c == "deleted_at":
            value = F.when(~seen, F.col(f"o.{c}"))
        elif c == "summary_embedding":
            value = F.when(~seen | (known & F.col("o.summary").eqNullSafe(F.col("n.summary"))), F.col(f"o.{c}"))
        elif c in OVERWRITTEN:
            value = F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        else:
            value = F.when(known, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")) if c in new.columns else F.col(f"o.{c}")
        out.append(value.cast(field.dataType).alias(c))
    return old.join(fresh, F.col("o.story_id") == F.col("n.story_id"), "full_outer").select(*out)


def add_bridge(story_fandoms: DataFrame, batch: DataFrame) -> DataFrame:
    """Insert if absent; rows never go."""
    return story_fandoms.unionByName(batch.select(*story_fandoms.columns)).dropDuplicates(["story_id", "fandom_id"])


def stale(as_of: str = AS_OF, days: int = STALE_DAYS) -> Column:
    return F.col("last_seen_at") < F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))


def mark_stale(stories: DataFrame, as_of: str = AS_OF, days: int = STALE_DAYS) -> tuple[DataFrame, DataFrame]:
    """The snapshot with tombstones on stories that were not seen for so many days, and one row `affected`."""
    hit = F.col("deleted_at").isNull() & stale(as_of, days)
    return stories.withColumn("deleted_at", F.when(hit, F.lit(as_of).cast("timestamp")).otherwise(F.col("deleted_at"))), stories.agg(F.count_if(hit).alias("affected"))


def record_progress(crawl_state: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Overwrites a surface's state with the batch's last one; ingested rows add up over the whole batch."""
    sums = batch.groupBy("surface_key").agg(F.sum("rows_ingested").alias("_rows"))
    new = last_wins(batch, ["surface_key"], order).drop("rows_ingested").join(sums, "surface_key")
    both = crawl_state.alias("o").join(new.alias("n"), F.col("o.surface_key") == F.col("n.surface_key"), "full_outer")
    seen = F.col("n.surface_key").isNotNull()
    rest = [c for c in crawl_state.columns if c not in ("surface_key", "rows_ingested")]
    return both.select(
        F.coalesce("o.surface_key", "n.surface_key").alias("surface_key"),
        (F.coalesce("o.rows_ingested", F.lit(0)) + F.coalesce("n._rows", F.lit(0))).alias("rows_ingested"),
        *[F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest],
    ).select(*crawl_state.columns)


def canonical_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs in ascending order only, each once; others are dropped."""
    return pairs.filter(F.col("fandom_id_a") < F.col("fandom_id_b")).dropDuplicates(["fandom_id_a", "fandom_id_b"])


def add_pairs(pairs: DataFrame, batch: DataFrame, fandoms: DataFrame) -> DataFrame:
    """Insert if absent, with the fandoms' slugs by id."""
    new = canonical_pairs(batch).join(pairs.select("fandom_id_a", "fandom_id_b"), ["fandom_id_a", "fandom_id_b"], "left_anti").select("fandom_id_a", "fandom_id_b")
    for k in "ab":
        slugs = fandoms.filter(F.col("category_id").isNotNull()).select(F.col("category_id").alias(f"fandom_id_{k}"), F.col("fandom_slug").alias(f"slug_{k}")).dropDuplicates([f"fandom_id_{k}"])
        new = new.join(slugs, f"fandom_id_{k}", "left")
    return pairs.unionByName(new.select(*pairs.columns))


def upsert_fandoms(fandoms: DataFrame, batch: DataFrame) -> DataFrame:
    """Three ways in order: a known category id leaves the row as it is; a known (section, slug) takes the new name and
    fills what was missing; else an unslugged name fills what was missing. The rest is inserted with ids above the
    highest. The batch has one row per identity; fandoms are a dimension of some ten thousand rows."""
    columns = fandoms.columns
    rest = batch.join(fandoms.filter(F.col("category_id").isNotNull()).select("category_id"), "category_id", "left_anti")
    slugged, bare = rest.filter(F.col("fandom_slug").isNotNull() & F.col("section_slug").isNotNull()), rest.filter(F.col("fandom_slug").isNull() | F.col("section_slug").isNull())
    fill = ("category_id", "story_count")

    def merged(old: DataFrame, new: DataFrame, keys: list[str], rename: bool) -> DataFrame:
        n = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in ("name", *fill) if c not in keys])
        out = old.join(n, keys, "left")
        for c in fill:
            out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
        if rename:
            out = out.withColumn("name", F.when(F.col("_hit"), F.col("_name")).otherwise(F.col("name")))
        return out.select(*columns)

    by_slug = merged(fandoms.filter(F.col("fandom_slug").isNotNull()), slugged, ["section_slug", "fandom_slug"], True)
    unslugged = merged(fandoms.filter(F.col("fandom_slug").isNull()), bare, ["name"], False)
    fresh = slugged.join(fandoms.select("section_slug", "fandom_slug"), ["section_slug", "fandom_slug"], "left_anti").unionByName(
        bare.join(fandoms.filter(F.col("fandom_slug").isNull()).select("name"), "name", "left_anti").select(*slugged.columns)
    )
    highest = fandoms.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_max"))
    place = F.row_number().over(Window.orderBy("name", "section_slug", "fandom_slug"))
    inserted = fresh.withColumn("_n", place).crossJoin(highest).withColumn("id", (F.col("_max") + F.col("_n")).cast(fandoms.schema["id"].dataType)).select(*columns)
    return reduce(DataFrame.unionByName, [by_slug, unslugged, inserted])


def write_back(stories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stores new embeddings by story id."""
    new = vectors.select("story_id", F.col("summary_embedding").alias("_v"))
    return stories.join(new, "story_id", "left").withColumn("summary_embedding", F.coalesce("_v", "summary_embedding")).select(*stories.columns)


def tail_matches(left: DataFrame, text: str, right: DataFrame, slug: str, joint: str = "-and-") -> DataFrame:
    """The pairs of rows for which `text LIKE '%' || joint || slug`. Each text's tails after a joint are keys that equal a slug, so
    nothing is compared pair by pair; a slug with `_` meets the tails of its length, one with `%` or a backslash the
    texts with a tail of its first letter. Columns of both sides stay; they must not clash."""
    tail, size = free_name("_tail", left, right), free_name("_size", left, right)
    own, n = F.col(text), len(joint)
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(own), F.lit(1))), lambda k: own.substr(k, F.lit(n)) == joint)  # joints may overlap
    parts = left.withColumn(tail, F.explode(F.array_distinct(F.transform(places, lambda k: own.substr(k + n, F.length(own))))))
    plain, single, open_ = (right.filter(F.regexp_like(slug, F.lit(p))) for p in (r"(?s)^[^%_\\]*$", r"(?s)^[^%\\]*_[^%\\]*$", r"[%\\]"))
    like = F.expr(f"`{tail}` LIKE `{slug}`")
    out = [parts.join(plain, F.col(tail) == F.col(slug)), parts.withColumn(size, F.length(tail)).join(single, (F.col(size) == F.length(slug)) & like).drop(size)]
    first = F.transform(places, lambda k: own.substr(k + n, F.lit(1)))
    letters = left.withColumn(tail, F.explode(F.array_union(first, F.array(F.lit("")))))
    start = F.when(F.regexp_like(slug, F.lit(r"^[%_\\]")), F.lit("")).otherwise(F.substring(slug, 1, 1))
    whole = F.expr(f"`{text}` LIKE concat('%{joint}', `{slug}`)")
    found = [x.drop(tail) for x in (*out, letters.join(open_, (F.col(tail) == start) & whole))]
    return reduce(DataFrame.unionByName, found)


def repair_identity(fandoms: DataFrame, story_fandoms: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The six steps of the fandom identity repair; each reads the result of the one before."""
    f = fandoms
    # 1: a mangled slug's id belongs to the fandom whose slug is its tail
    others = f.filter(F.col("category_id").isNotNull() & F.col("fandom_slug").isNotNull()).select(F.col("id").alias("oid"), F.col("category_id").alias("ocat"), F.col("fandom_slug").alias("oslug"))
    same = (F.col("category_id") == F.col("ocat")) & (F.col("id") != F.col("oid")) & F.expr("oslug LIKE concat('%-and-', fandom_slug)")
    wrong = f.filter(F.col("fandom_slug").isNotNull()).join(others, same, "left_semi").select("id", F.lit(True).alias("_wrong"))
    f = f.join(wrong, "id", "left").withColumn("category_id", F.when(F.col("_wrong").isNull(), F.col("category_id"))).drop("_wrong").select(*fandoms.columns)
    # 2: an id that several slugged fandoms share is no one's
    n = F.count(F.when(F.col("section_slug").isNotNull(), 1)).over(Window.partitionBy("category_id"))
    f = f.withColumn("_n", n).withColumn("category_id", F.when(~(F.col("section_slug").isNotNull() & (F.col("_n") > 1)), F.col("category_id"))).select(*fandoms.columns)
    # 3: orphans point at the slugged fandom of their id
    real = f.filter(F.col("section_slug").isNotNull() & F.col("category_id").isNotNull()).select("category_id", F.col("id").alias("_to"))
    moved = f.filter(F.col("section_slug").isNull()).join(real, "category_id").select(F.col("id").alias("fandom_id"), "_to")
    bridge = story_fandoms.join(moved, "fandom_id", "left").select("story_id", F.coalesce("_to", "fandom_id").alias("fandom_id")).dropDuplicates(["story_id", "fandom_id"])
    f = f.join(moved.select(F.col("fandom_id").alias("id")), "id", "left_anti")
    # 4: of the other orphans of an id the smallest survives
    orphans = f.filter(F.col("section_slug").isNull() & F.col("category_id").isNotNull())
    best = orphans.groupBy("category_id").agg(F.min("id").alias("_to"))
    joined = orphans.join(best, "category_id").select(F.col("id").alias("fandom_id"), "_to")
    bridge = bridge.join(joined, "fandom_id", "left").select("story_id", F.coalesce("_to", "fandom_id").alias("fandom_id")).dropDuplicates(["story_id", "fandom_id"])
    f = f.join(joined.filter(F.col("fandom_id") != F.col("_to")).select(F.col("fandom_id").alias("id")), "id", "left_anti")
    orphan = F.col("section_slug").isNull() & F.col("category_id").isNotNull()
    f = f.withColumn("name", F.when(orphan, F.concat(F.lit("FFN category "), F.col("category_id").cast("string"))).otherwise(F.col("name"))).withColumn("fandom_slug", F.when(~orphan, F.col("fandom_slug")))
    # 5: pair slugs follow the fandoms'
    p = pairs
    for k in "ab":
        slugs = f.filter(F.col("category_id").isNotNull() & F.col("fandom_slug").isNotNull()).select(F.col("category_id").alias(f"fandom_id_{k}"), F.col("fandom_slug").alias("_slug"))
        p = p.join(slugs, f"fandom_id_{k}", "left").withColumn(f"slug_{k}", F.coalesce("_slug", f"slug_{k}")).drop("_slug")
    return f.select(*fandoms.columns), bridge, p.select(*pairs.columns)


def identity_conflicts(fandoms: DataFrame) -> DataFrame:
    """Step 6: what breaks one of the three partial unique keys."""
    rules = {"slug": (["section_slug", "fandom_slug"], "fandom_slug IS NOT NULL"), "category": (["category_id"], "category_id IS NOT NULL"), "name": (["name"], "fandom_slug IS NULL")}
    return reduce(DataFrame.unionByName, [fandoms.filter(w).groupBy(F.concat_ws("/", *k).alias("value")).count().filter("count > 1").select(F.lit(n).alias("key"), "value", "count") for n, (k, w) in rules.items()])
