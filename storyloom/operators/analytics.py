"""Facets, corpus statistics, the analytic reports, work queues and backfill estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.functions.listing import COUNTS
from storyloom.operators.filters import is_abandoned, overlaps
from storyloom.operators.search import with_ratio
from storyloom.plans.corpus import AS_OF
from storyloom.schema import FACET_LIMITS, GENRES


def live(stories: DataFrame) -> DataFrame:
    return stories.filter(F.col("deleted_at").isNull())


def ship_label(group: Column) -> Column:
    """A bracket group's members, sorted and joined; duplicates stay."""
    return F.array_join(F.array_sort(group), " / ")


def facets(stories: DataFrame, story_fandoms: DataFrame, fandoms: DataFrame) -> DataFrame:
    """(facet, value, count) of live stories. The five facets of a story's own columns come from one scan, exploded and
    counted map-side; only the fandoms need the bridge."""

    def entries(name: str, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(name).alias("facet"), x.alias("value")))

    def one(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("facet"), value.alias("value")))).otherwise(F.array().cast("array<struct<facet:string,value:string>>"))

    rows = live(stories)
    every = F.concat(entries("genres", F.col("genres")), entries("characters", F.col("characters")), one("languages", F.col("language")), one("ratings", F.col("rating")), entries("ships", F.transform("ships", ship_label)))
    own = rows.select(F.explode(every).alias("e")).select("e.facet", "e.value")
    counted = own.groupBy("facet", "value").agg(F.count("*").alias("count"))
    by_id = story_fandoms.join(rows.select("story_id"), "story_id", "left_semi").groupBy("fandom_id").agg(F.count("*").alias("n"))
    named = by_id.join(fandoms.select(F.col("id").alias("fandom_id"), "name"), "fandom_id").groupBy(F.lit("fandoms").alias("facet"), F.col("name").alias("value")).agg(F.sum("n").alias("count"))
    return counted.unionByName(named)


def top_facets(counts: DataFrame, limits: dict[str, int] = FACET_LIMITS) -> DataFrame:
    """Each facet's most frequent values in one pass. The largest limit stands as a literal, by which Spark keeps no more
    rows than that of a facet in a task before it shuffles and sorts them."""
    place = Window.partitionBy("facet").orderBy(F.col("count").desc(), F.col("value"))
    most = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])[F.col("facet")]
    return counts.withColumn("place", F.row_number().over(place)).filter((F.col("place") <= max(limits.values())) & (F.col("place") <= most)).select("facet", "value", "count")


def stats(stories: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """The headline counts, one row."""
    return live(stories).agg(
        F.count("*").alias("stories"), F.countDistinct("author_id").alias("authors"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(is_abandoned(as_of)).alias("abandoned"),
        F.count_if(F.size("ships") > 0).alias("with_ships"), F.count_if("is_crossover").alias("crossovers"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.min("published_at").cast("date").alias("earliest"), F.max("published_at").cast("date").alias("latest"), F.lit(as_of).alias("computed_at"),
    )


def whole_years(newer: Column, older: Column) -> Column:
    return F.floor(F.months_between(newer, older) / 12).cast("int")


def top(rows: DataFrame, *order: Column, n: int = 20) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def abandonment_report(stories: DataFrame, as_of: str = AS_OF, n: int = 20) -> DataFrame:
    rows = live(stories).filter(is_abandoned(as_of) & (F.col("word_count") > 20_000))
    rows = top(rows, F.col("favorite_count").desc(), F.col("story_id").desc(), n=n)
    stale = whole_years(F.lit(as_of).cast("timestamp"), F.col("updated_at"))
    return rows.select("story_id", "title", "author_name", "word_count", "chapter_count", F.col("updated_at").cast("date").alias("last_touched"), stale.alias("years_stale"), "favorite_count")


def length_adjusted(stories: DataFrame, n: int = 20) -> DataFrame:
    rows = with_ratio(live(stories)).filter(F.col("word_count").between(1000, 20_000) & (F.col("favorite_count") > 20))
    return top(rows, F.col("favorites_per_1k_words").desc(), F.col("story_id").desc(), n=n).select("story_id", "title", "author_name", "word_count", "favorite_count", "favorites_per_1k_words")


def ship_aggregates(stories: DataFrame) -> DataFrame:
    """Stories, words and mean favourites of every ship."""
    rows = live(stories).filter(F.size("ships") > 0).select(F.explode("ships").alias("g"), "word_count", "favorite_count")
    return rows.groupBy(ship_label(F.col("g")).alias("ship")).agg(F.count("*").alias("stories"), F.sum("word_count").alias("total_words"), F.round(F.avg("favorite_count")).alias("avg_favorites"))


def ship_leaderboard(stories: DataFrame, n: int = 20) -> DataFrame:
    return top(ship_aggregates(stories), F.col("stories").desc(), F.col("ship"), n=n)


def exclusions(stories: DataFrame, n: int = 20) -> DataFrame:
    rows = live(stories).filter((F.col("status") == "complete") & (F.col("word_count") > 10_000) & ~overlaps("genres", ["Romance"]) & ~overlaps("characters", ["OC"]))
    return top(rows, F.col("favorite_count").desc(), F.col("story_id").desc(), n=n).select("story_id", "title", "author_name", "genres", "characters", "word_count", "favorite_count")


def corpus_shape(stories: DataFrame) -> DataFrame:
    return live(stories).agg(
        F.count("*").alias("stories"), F.countDistinct("author_id").alias("authors"), F.count_if(F.col("status") == "complete").alias("complete"), F.count_if(F.size("ships") > 0).alias("with_ships"),
        F.count_if("is_crossover").alias("crossovers"), F.countDistinct("language").alias("languages"), F.sum(F.octet_length("summary") + F.octet_length("title")).alias("text_bytes"),
        F.min("published_at").cast("date").alias("earliest"), F.max("published_at").cast("date").alias("latest"),
    )


# --- progress and queues


def progress(stories: DataFrame, crawl_state: DataFrame) -> DataFrame:
    """Stories, embedded ones, exhausted and all browse surfaces: two one-row aggregates side by side."""
    a = live(stories).agg(F.count("*").alias("stories"), F.count("summary_embedding").alias("embedded"))
    b = crawl_state.filter(F.col("surface_key").startswith("browse:")).agg(F.count_if(F.coalesce("is_exhausted", F.lit(False))).alias("exhausted"), F.count("*").alias("surfaces"))
    return a.crossJoin(b)


def pending(state: Column) -> Column:
    """IS NOT TRUE."""
    return ~F.coalesce(state, F.lit(False))


def pending_fandoms(fandoms: DataFrame, crawl_state: DataFrame, limit: int | None = None) -> DataFrame:
    """Fandoms with both slugs whose archive is not walked out, smallest first."""
    keyed = fandoms.filter(F.col("section_slug").isNotNull() & F.col("fandom_slug").isNotNull()).withColumn("surface_key", F.concat(F.lit("browse:"), "section_slug", F.lit("/"), "fandom_slug"))
    rows = keyed.join(crawl_state.select("surface_key", "is_exhausted", "last_page"), "surface_key", "left").filter(pending(F.col("is_exhausted")))
    rows = rows.orderBy(F.col("story_count").asc_nulls_last(), F.col("name"))
    return rows if limit is None else rows.limit(limit)


def pending_pairs(pairs: DataFrame, crawl_state: DataFrame, fandoms: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs whose archive is not walked out, with the fandoms' slugs where known, else the stored ones."""
    keyed = pairs.withColumn("surface_key", F.concat(F.lit("crossover:"), F.col("fandom_id_a").cast("string"), F.lit("/"), F.col("fandom_id_b").cast("string")))
    rows = keyed.join(crawl_state.select("surface_key", "is_exhausted"), "surface_key", "left").filter(pending(F.col("is_exhausted")))
    for k in "ab":
        slugs = fandoms.filter(F.col("category_id").isNotNull()).select(F.col("category_id").alias(f"fandom_id_{k}"), F.col("fandom_slug").alias(f"known_{k}"))
        rows = rows.join(slugs, f"fandom_id_{k}", "left").withColumn(f"slug_{k}", F.coalesce(f"known_{k}", f"slug_{k}"))
    rows = rows.select("fandom_id_a", "fandom_id_b", "slug_a", "slug_b").orderBy("fandom_id_a", "fandom_id_b")
    return rows if limit is None else rows.limit(limit)


# --- estimates


#: Fixed values of the backfill estimate: rows and seconds per request, stories per pair, bytes per row and per vector.
ROWS_PER_REQUEST, SECONDS_PER_REQUEST, STORIES_PER_PAIR, ROW_BYTES, VECTOR_BYTES, INDEX_FACTOR, HIGHEST_ID = 24.5, 5.83, 4.17, 409, 3072, 1.4, 14_584_841


def backfill_estimate(totals: DataFrame) -> DataFrame:
    """One row stories, fandoms, crossover_fandoms, pairs to requests, wall-clock and storage."""
    s, f, c, p = (F.col(k) for k in ("stories", "fandoms", "crossover_fandoms", "pairs"))
    pair_pages = max(1.0, STORIES_PER_PAIR / ROWS_PER_REQUEST)
    requests = s / ROWS_PER_REQUEST + f + (2 * 9 + c) + p * (pair_pages + 1)
    shortcut = s / ROWS_PER_REQUEST + 0.5 * f + (2 * 9 + c) + p * pair_pages
    raw = s * ROW_BYTES + s * VECTOR_BYTES
    return totals.select(
        s.alias("stories"), F.round(requests, 3).alias("requests"), F.round(requests * SECONDS_PER_REQUEST, 3).alias("seconds"), F.round(shortcut * SECONDS_PER_REQUEST, 3).alias("shortcut_seconds"),
        raw.cast("long").alias("raw_bytes"), F.round(raw * INDEX_FACTOR, 1).alias("indexed_bytes"), (s > HIGHEST_ID).alias("implausible"),
    )


def footprint(objects: DataFrame, stories: int, target: int = 8_770_708, least: int = 100_000) -> DataFrame:
    """Projects object sizes (name, bytes, is_vector, is_ann_index) of so many stories to the target, with three variants."""
    per = F.sum("bytes") / stories * target
    vec = F.sum(F.when(F.col("is_vector"), F.col("bytes")).otherwise(0)) / stories * target
    return objects.filter(F.col("bytes") >= least).agg(
        F.round(per, 0).alias("projected"), F.round(per - vec * 0.5, 0).alias("half_precision"), F.round(per - vec * 0.57, 0).alias("without_ann_index"), F.round(per - vec, 0).alias("without_embeddings")
    )


#: A selection pass counts values in so many ranges; so few values of one range are sorted at last.
RANGES, FEW_VALUES = 1024, 10_000


def order_statistic(values: DataFrame, column: str, rank: int):
    """The rank-th smallest number (from 0) of a column, nulls left out, or None. Each pass counts the values of what range is
    left in RANGES equal parts, map-side, and goes on with the part that holds the rank; the last FEW_VALUES or equal
    values are sorted. No task and no driver holds more than that, whatever the table's size."""
    rows = values.filter(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    while True:
        if not 0 <= rank < ends.n:
            return None
        if ends.lo == ends.hi:
            return ends.lo
        rows = rows.filter((F.col("x") >= F.lit(ends.lo)) & (F.col("x") <= F.lit(ends.hi)))
        if ends.n <= FEW_VALUES or float(ends.lo) == float(ends.hi):
            return rows.orderBy("x").offset(rank).limit(1).first().x
        low, span = float(ends.lo), float(ends.hi) - float(ends.lo)
        part = F.least(F.floor((F.col("x").cast("double") - low) / (span / RANGES)), F.lit(RANGES - 1))
        counted = rows.groupBy(part.alias("part")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).orderBy("part").collect()
        for ends in counted:
            if rank < ends.n:
                break
            rank -= ends.n


def sample_statistics(values: DataFrame, column: str, population: int) -> DataFrame:
    """Median (upper), mean and maximum of a sample, and the total it predicts."""
    kind = values.schema[column].dataType
    agg = values.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.max(column).alias("largest"))
    median = order_statistic(values, column, agg.first().n // 2)
    return agg.select(F.lit(median).cast(kind).alias("median"), F.round("mean", 6).alias("mean"), "largest", F.round(F.col("mean") * population, 3).alias("predicted"))


#: A character that is a number or a count of the meta line.
COUNT_LIKE = "^([0-9][0-9,.]*|(" + "|".join(COUNTS.values()) + "):.*)$"


def anomalies(stories: DataFrame) -> DataFrame:
    """One row of counts of live stories that break a rule of the parser, in one scan."""
    rules = {
        "no_rating": F.col("rating").isNull(), "no_language": F.col("language").isNull(), "no_words": F.col("word_count").isNull(), "no_date": F.col("published_at").isNull(), "dates_reversed": F.col("updated_at") < F.col("published_at"),
        "many_genres": F.size("genres") > 2, "unknown_genre": F.exists("genres", lambda g: ~g.isin(*GENRES)), "no_title": F.coalesce(F.trim("title"), F.lit("")) == "", "markup": F.regexp_like("summary", F.lit("<[A-Za-z/]")),
        "count_as_character": F.exists("characters", lambda x: F.regexp_like(x, F.lit(COUNT_LIKE))),
    }
    return live(stories).agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])


def stride_sample(rows: DataFrame, order: str, stride: int, most: int = 16) -> DataFrame:
    """Every stride-th row in order, at most `most`: for directory lists, which are small."""
    n = F.row_number().over(Window.orderBy(order))
    return rows.withColumn("n", n).filter((F.col("n") - 1) % stride == 0).orderBy("n").limit(most).drop("n")


def directory_totals(fandoms: DataFrame) -> DataFrame:
    """Fandoms and stories per section, and the total (null section) in the same pass. An empty directory is an error."""
    return fandoms.filter(F.col("section_slug").isNotNull()).rollup("section_slug").agg(F.count("*").alias("fandoms"), F.sum("story_count").alias("stories"))


def duration(seconds: Column) -> Column:
    """1d 1h from a day on, else 1.5h."""
    hours = F.format_string("%.1fh", F.bround(seconds.cast("double") / 3600, 1))
    return F.when(seconds >= 86400, F.format_string("%dd %dh", F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600))).otherwise(hours)


def human_duration(seconds: float) -> str:
    days, hours = int(seconds // 86400), seconds % 86400 / 3600
    return f"{days}d {int(hours)}h" if days else f"{hours:.1f}h"
