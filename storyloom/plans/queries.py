"""The operator inventory as queries over the driver's tables, each with DuckDB SQL for the same rows.

Array columns are joined to text, dates and timestamps cast to text and decimals to double at the end, so that both
engines' values compare."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import listing, vectors
from storyloom.functions import text as fulltext
from storyloom.operators import analytics, bitmaps, gramindex, ingest, search, signindex, textindex, topktext, versions, walk
from storyloom.operators.filters import SearchFilters, filtered, is_abandoned, is_abandoned_by_days, overlaps
from storyloom.plans import corpus
from storyloom.plans.corpus import AS_OF
from storyloom.schema import EMBEDDING_CHARS, GENRES, favorites_per_1k, sign_bits
from storyloom.session import scratch_path
from storyloom.sources import archives, surfaces
from storyloom.streaming import crawl, feeds


class Corpus:
    """The tables of one folder, loaded when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return corpus.load(self.spark, self.sf_dir, name)

    @cached_property
    def stories(self) -> DataFrame:
        return self("stories_base")

    @cached_property
    def embedded(self) -> DataFrame:
        return self("stories")

    @cached_property
    def query_vector(self) -> list[float]:
        """The vector with the smallest id, as a user's query: one row."""
        return list(self("embeddings").orderBy("vec_id").first().embedding)


def plain(df: DataFrame) -> DataFrame:
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "array<string>":
            c = F.array_join(c, "|")
        elif kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)


REGISTRY: dict[str, tuple[Callable[[Corpus], DataFrame], str | None]] = {}


def query(name: str, sql: str | None):
    """Registers a function of the corpus under an inventory id, with its SQL."""

    def add(f: Callable[[Corpus], DataFrame]):
        REGISTRY[name] = (f, sql)
        return f

    return add


TS = f"TIMESTAMP '{AS_OF}'"
ABANDONED = f"(status = 'in_progress' AND updated_at < {TS} - INTERVAL '2' YEAR)"
RATIO = "CASE WHEN word_count > 0 THEN round(favorite_count * 1000.0 / word_count, 4) END"
SHIP = "array_to_string(list_sort(g), ' / ')"


def by_filter(name: str, where: str, **filters) -> None:
    """A query of ids that pass one search filter."""
    sql = f"SELECT story_id, favorite_count FROM stories_base WHERE deleted_at IS NULL AND ({where})"
    query(name, sql)(lambda c: filtered(c.stories, SearchFilters(**filters), c("story_fandoms"), c("fandoms")).select("story_id", "favorite_count"))


# --- sources

query("S01_live_scan", "SELECT story_id, title FROM stories_base WHERE deleted_at IS NULL")(lambda c: analytics.live(c.stories).select("story_id", "title"))


@query("S02_bridge_dimension_scan", "SELECT fandom_id, name, count(*) AS stories FROM story_fandoms JOIN fandoms ON id = fandom_id GROUP BY fandom_id, name")
def _(c: Corpus) -> DataFrame:
    counted = c("story_fandoms").groupBy("fandom_id").agg(F.count("*").alias("stories"))
    return counted.join(c("fandoms").select(F.col("id").alias("fandom_id"), "name"), "fandom_id").select("fandom_id", "name", "stories")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def rendered(stories: DataFrame) -> DataFrame:
    """(story_id, html): each story as a listing row, the inverse of the parser."""
    loose = F.array_except("characters", F.flatten("ships"))
    groups = F.transform("ships", lambda g: F.concat(F.lit("["), F.array_join(g, ", "), F.lit("]")))
    people = F.trim(F.concat_ws(" ", F.array_join(groups, " "), F.array_join(loose, ", ")))

    def count(label: str, column: str) -> Column:
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{label}: "), F.format_number(column, 0)))

    def dated(label: str, column: str) -> Column:
        seconds = F.unix_timestamp(column).cast("string")
        return F.when(F.col(column).isNotNull(), F.concat(F.lit(f"{label}: <span data-xutime='"), seconds, F.lit("'>x</span>")))

    meta = F.concat_ws(
        " - ", F.when(F.col("is_crossover"), "Alpha + Beta Crossover"), F.concat(F.lit("Rated: "), F.coalesce("rating", F.lit(""))), "language", F.when(F.size("genres") > 0, F.array_join("genres", "/")), count("Chapters", "chapter_count"), count("Words", "word_count"),
        count("Reviews", "review_count"), count("Favs", "favorite_count"), count("Follows", "follow_count"), dated("Updated", "updated_at"), dated("Published", "published_at"),
        F.when(people != "", people), F.when(F.col("status") == "complete", "Complete"),
    )
    cover = F.coalesce(F.concat(F.lit("<img data-original='/image/"), F.col("cover_image_id").cast("string"), F.lit("/75/'>")), F.lit(""))
    row = F.concat(
        F.lit("<div class='z-list zhover'><a  class=stitle href=\"/s/"), F.col("story_id").cast("string"), F.lit('/1/x">'), cover, escaped(F.col("title")), F.lit('</a> by <a href="/u/'), F.col("author_id").cast("string"), F.lit("/"), "author_name",
        F.lit("\">x</a><div class='z-indent z-padtop'>"), escaped(F.col("summary")), F.lit("<div class='z-padtop2 xgray'>"), meta, F.lit("</div></div></div>"),
    )
    return stories.select("story_id", row.alias("html"))


def parsed(c: Corpus) -> DataFrame:
    return listing.listing_rows(rendered(c.stories).select("html"))


RATED = "FROM stories_base"


@query("S03_listing_source", f"SELECT story_id, author_id, author_name, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, cover_image_id {RATED}")
def _(c: Corpus) -> DataFrame:
    return parsed(c).select("story_id", "author_id", "author_name", "title", "cover_image_id")


def listed(c: Corpus) -> DataFrame:
    """Listing pages of all stories: up to 25 rows a page by id, up to 100 pages a surface."""
    rows = rendered(c.stories).withColumn("page", F.floor(F.col("story_id") / 25))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("story_id", "html"))), lambda x: x["html"]), "\n").alias("html"))
    return pages.select(F.format_string("browse:book/s%d", F.floor(F.col("page") / 100)).alias("surface_key"), (F.col("page") % 100 + 1).cast("int").alias("page_no"), F.lit(AS_OF).cast("timestamp").alias("fetched_at"), "html")


LISTED = "concat('browse:book/s', CAST(story_id // 2500 AS VARCHAR)) AS surface_key, CAST(story_id // 25 % 100 + 1 AS INT) AS page_no"


@query("S03_archive_source", f"SELECT story_id, author_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, word_count, favorite_count, {LISTED} {RATED}")
def _(c: Corpus) -> DataFrame:
    """The pages are written to archives and read back through the data source."""
    root = scratch_path(c.spark, "archives")
    archives.write_pages(listed(c), root)
    return archives.stories_of(archives.read_archives(c.spark, root)).select("story_id", "author_id", "title", "word_count", "favorite_count", "surface_key", "page_no")


@query("S05_archive_stream", f"SELECT story_id, favorite_count, {LISTED}, CAST(1 AS BIGINT) AS times {RATED}")
def _(c: Corpus) -> DataFrame:
    """A stream follows archives that grow: it ends between two jobs of a crawl and goes on from its offset."""
    root, taken = scratch_path(c.spark, "archives"), scratch_path(c.spark, "taken")
    pages = listed(c)
    for turn in (0, 1):
        archives.write_pages(pages.filter(F.col("page_no") % 2 == turn), root)
        # a micro-batch has all of its stream's columns computed, so they are chosen before it
        rows = archives.stories_of(archives.stream_archives(c.spark, root)).select("story_id", "favorite_count", "surface_key", "page_no")
        feeds.run_available(rows, f"{taken}-mark", lambda batch, n: batch.write.mode("overwrite").parquet(f"{taken}/batch={n}"))
    found = c.spark.read.schema("story_id long, favorite_count int, surface_key string, page_no int").parquet(taken)
    return found.groupBy("story_id", "favorite_count", "surface_key", "page_no").agg(F.count("*").alias("times"))


@query("S05_archive_urls", "SELECT id, concat('https://www.fanfiction.net/', section_slug, '/', fandom_slug, '/?srt=1&r=10&p=', CAST(id % 5 + 1 AS VARCHAR), '&s=2') AS url FROM fandoms WHERE section_slug IS NOT NULL")
def _(c: Corpus) -> DataFrame:
    rows = c("fandoms").filter(F.col("section_slug").isNotNull())
    return rows.select("id", surfaces.browse_url(F.col("section_slug"), F.col("fandom_slug"), F.col("id") % 5 + 1, "update", "complete").alias("url"))


@query(
    "S06_crossover_urls",
    "SELECT s_suppkey, concat('https://www.fanfiction.net/', CASE WHEN s_suppkey > s_nationkey THEN 'B' ELSE 'A' END, '-and-', CASE WHEN s_suppkey > s_nationkey THEN 'A' ELSE 'B' END, '-Crossovers/', "
    "CAST(least(s_suppkey, s_nationkey) AS VARCHAR), '/', CAST(greatest(s_suppkey, s_nationkey) AS VARCHAR), '/?srt=2&r=10&p=1') AS url FROM supplier",
)
def _(c: Corpus) -> DataFrame:
    return c("supplier").select("s_suppkey", surfaces.crossover_archive_url(F.lit("A"), F.col("s_suppkey"), F.lit("B"), F.col("s_nationkey").cast("long"), F.lit(1)).alias("url"))


@query(
    "S07_section_directories",
    "SELECT x.s AS section, concat('https://www.fanfiction.net/', x.s, '/') AS url, count(f.id) AS known_fandoms FROM (SELECT unnest(['anime','book','cartoon','comic','game','misc','movie','play','tv']) AS s) x LEFT JOIN fandoms f ON f.section_slug = x.s GROUP BY x.s",
)
def _(c: Corpus) -> DataFrame:
    return surfaces.section_directories(c.spark, c("fandoms")).select("section", "url", "known_fandoms")


@query("S08_crossover_directories", "SELECT id, concat('https://www.fanfiction.net/crossovers/', fandom_slug, '/', CAST(category_id AS VARCHAR), '/') AS url FROM fandoms WHERE fandom_slug IS NOT NULL")
def _(c: Corpus) -> DataFrame:
    return c("fandoms").filter(F.col("fandom_slug").isNotNull()).select("id", surfaces.partners_url(F.col("fandom_slug"), F.col("category_id")).alias("url"))


@query("S09_search_urls", "SELECT id, concat('https://www.fanfiction.net/search/?keywords=', replace(name, ' ', '+'), '&ready=1&type=story&ppage=2&categoryid=7') AS url FROM fandoms")
def _(c: Corpus) -> DataFrame:
    return c("fandoms").select("id", surfaces.search_url(F.col("name"), 2, 7).alias("url"))


@query("S10_story_urls", "SELECT story_id, concat('https://www.fanfiction.net/s/', CAST(story_id AS VARCHAR), '/', CAST(chapter_count AS VARCHAR), '/') AS url FROM stories_base")
def _(c: Corpus) -> DataFrame:
    return c.stories.select("story_id", surfaces.story_url(F.col("story_id"), F.col("chapter_count")).alias("url"))


@query(
    "S11_response_classes",
    "SELECT event_type, CASE event_type WHEN 'signup' THEN 'blocked' WHEN 'view' THEN 'ok' WHEN 'click' THEN 'not_found' WHEN 'purchase' THEN 'app_error' ELSE 'server_error' END AS outcome, count(*) AS n FROM events GROUP BY ALL",
)
def _(c: Corpus) -> DataFrame:
    status = F.when(F.col("event_type") == "signup", 403).when(F.col("event_type") == "error", 503).otherwise(200)
    body = F.when(F.col("event_type") == "click", f"<p>{surfaces.NOT_FOUND}.").when(F.col("event_type") == "purchase", f"{surfaces.APPLICATION_ERROR} 1").otherwise("<html>")
    return c("events").select("event_type", surfaces.classified(status, body).alias("outcome")).groupBy("event_type", "outcome").agg(F.count("*").alias("n"))


@query("S12_embedding_source", "SELECT story_id, 64 AS dims FROM stories WHERE deleted_at IS NULL AND summary_embedding IS NULL")
def _(c: Corpus) -> DataFrame:
    return vectors.embed_missing(c.embedded, dims=64).select("story_id", F.size("summary_embedding").alias("dims"))


# --- projections

query("P02_is_abandoned", f"SELECT story_id, {ABANDONED} AS is_abandoned FROM stories_base")(lambda c: c.stories.select("story_id", is_abandoned().alias("is_abandoned")))
query("P04_result_url", "SELECT story_id, concat('https://www.fanfiction.net/s/', CAST(story_id AS VARCHAR), '/1/') AS url FROM stories_base")(lambda c: search.projected(search.with_ratio(c.stories), AS_OF).select("story_id", "url"))
query("P05_favorites_per_1k", f"SELECT story_id, {RATIO} AS ratio FROM stories_base")(lambda c: c.stories.select("story_id", favorites_per_1k(F.col("favorite_count"), F.col("word_count")).alias("ratio")))
query("P08_embedding_text", f"SELECT story_id, substr(trim(concat(title, '. ', summary)), 1, {EMBEDDING_CHARS}) AS text FROM stories_base")(lambda c: c.stories.select("story_id", vectors.embedding_text(F.col("title"), F.col("summary")).alias("text")))
query("P10_updated_fallback", "SELECT story_id, CAST(coalesce(updated_at, published_at) AS VARCHAR) AS seen FROM stories_base")(lambda c: c.stories.select("story_id", F.coalesce("updated_at", "published_at").alias("seen")))


@query(
    "P01_result_projection",
    f"SELECT story_id, title, author_id, author_name, summary, is_crossover, rating, language, array_to_string(genres, '|') AS genres, array_to_string(characters, '|') AS characters, chapter_count, word_count, review_count, favorite_count, "
    f"follow_count, status, CAST(published_at AS VARCHAR) AS published_at, CAST(updated_at AS VARCHAR) AS updated_at, {RATIO} AS favorites_per_1k_words FROM stories_base",
)
def _(c: Corpus) -> DataFrame:
    return search.with_ratio(c.stories).select(*[k for k in search.RESULT if k != "ships"])


@query("P03_fandom_names", "SELECT s.story_id, coalesce((SELECT string_agg(f.name, '|' ORDER BY f.name) FROM story_fandoms b JOIN fandoms f ON f.id = b.fandom_id WHERE b.story_id = s.story_id), '') AS fandoms FROM stories_base s")
def _(c: Corpus) -> DataFrame:
    return search.with_fandoms(c.stories.select("story_id"), c("story_fandoms"), c("fandoms"))


@query("P07_sign_bits", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END))::BIGINT AS ones, CAST(embedding[1] > 0 AS INT) AS first_bit FROM embeddings")
def _(c: Corpus) -> DataFrame:
    bits = sign_bits(F.col("embedding"))
    return c("embeddings").select("vec_id", F.bit_count(bits[0]).cast("long").alias("ones"), bits[0].bitwiseAND(F.lit(1)).cast("int").alias("first_bit"))


@query("P06_search_document", "SELECT story_id, len(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'))::INT AS a, len(regexp_extract_all(lower(author_name), '[\\p{L}\\p{N}]+'))::INT AS b, len(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+'))::INT AS c FROM stories_base")
def _(c: Corpus) -> DataFrame:
    return fulltext.with_document(c.stories).select("story_id", F.size("doc_a").alias("a"), F.size("doc_b").alias("b"), F.size("doc_c").alias("c"))


@query("P09_context_fandoms", "SELECT story_id, CASE WHEN is_crossover THEN 'Alpha|Beta' ELSE 'Gamma' END AS fandom_names, is_crossover FROM stories_base")
def _(c: Corpus) -> DataFrame:
    return listing.with_context(parsed(c), F.array(F.lit("Gamma"))).select("story_id", "fandom_names", "is_crossover")


# --- filters

by_filter("F01_tombstone", "true")
by_filter("F05_rating", "rating IN ('T', 'M')", ratings=["T", "M"])
by_filter("F06_language", "language IN ('fr', 'de')", languages=["fr", "de"])
by_filter("F07_genre_overlap", "list_has_any(genres, ['Humor', 'Romance'])", genres=["Humor", "Romance"])
by_filter("F08_genre_exclude", "NOT list_has_any(genres, ['Romance', 'Horror'])", excluded_genres=["Romance", "Horror"])
by_filter("F09_character_overlap", "list_has_any(characters, ['OC', 'Ciel P.'])", characters=["OC", "Ciel P."])
by_filter("F10_character_exclude", "NOT list_has_any(characters, ['OC'])", excluded_characters=["OC"])
by_filter("F11_ship_one_group", "len(list_filter(ships, lambda g: len(list_distinct(list_intersect(g, ['Harry P.', 'Ginny W.']))) = 2)) > 0", ship=["Ginny W.", "Harry P.", "Harry P."])
by_filter("F12_status", "status = 'complete'", status="complete")
by_filter("F13_crossover", "NOT is_crossover", crossover=False)
by_filter("F14_exclude_abandoned", f"NOT {ABANDONED}", exclude_abandoned=True)
by_filter("F15_only_abandoned", ABANDONED, only_abandoned=True)
by_filter("F16_min_words", "word_count >= 0", min_words=0)
by_filter("F17_max_words", "word_count <= 5000", max_words=5000)
by_filter("F18_min_favorites", "favorite_count >= 200", min_favorites=200)
by_filter("F19_min_chapters", "chapter_count >= 12", min_chapters=12)
by_filter("F03_text_and", "regexp_matches(lower(concat(title, ' ', author_name, ' ', summary)), '(^|[^\\p{L}\\p{N}])with([^\\p{L}\\p{N}]|$)') AND NOT regexp_matches(lower(concat(title, ' ', author_name, ' ', summary)), '(^|[^\\p{L}\\p{N}])this([^\\p{L}\\p{N}]|$)')", query="with -this")
by_filter("F03_text_or_phrase", "regexp_matches(concat(' ', array_to_string(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}]+'), ' '), ' '), ' (of the|und) ') OR regexp_matches(concat(' ', array_to_string(regexp_extract_all(lower(title), '[\\p{L}\\p{N}]+'), ' '), ' '), ' (of the|und) ')", query='"of the" or und')
by_filter("F04_fandom_any", "EXISTS (SELECT 1 FROM story_fandoms b JOIN fandoms f ON f.id = b.fandom_id WHERE b.story_id = stories_base.story_id AND f.name IN ('Fandom 3', 'Fandom 11'))", fandoms=["Fandom 3", "Fandom 11"])
REGISTRY["J01_fandom_semi_join"] = REGISTRY["F04_fandom_any"]
query("F02_has_embedding", "SELECT story_id FROM stories WHERE deleted_at IS NULL AND summary_embedding IS NOT NULL AND status = 'complete'")(lambda c: filtered(c.embedded, SearchFilters(vector=c.query_vector, status="complete")).select("story_id"))
query("F20_between", "SELECT story_id FROM live WHERE word_count BETWEEN 1000 AND 20000")(lambda c: analytics.live(c.stories).filter(F.col("word_count").between(1000, 20000)).select("story_id"))
query("F21_has_ships", "SELECT story_id FROM live WHERE len(ships) > 0")(lambda c: analytics.live(c.stories).filter(F.size("ships") > 0).select("story_id"))
query("F22_is_not_true", "SELECT surface_key FROM crawl_state WHERE is_exhausted IS NOT TRUE")(lambda c: c("crawl_state").filter(analytics.pending(F.col("is_exhausted"))).select("surface_key"))
query("F23_is_distinct_from", "SELECT story_id FROM stories_base WHERE updated_at IS DISTINCT FROM published_at")(lambda c: c.stories.filter(~F.col("updated_at").eqNullSafe(F.col("published_at"))).select("story_id"))
query("F24_like_from_column", "SELECT p.fandom_id_a, p.fandom_id_b, f.id FROM pairs p JOIN fandoms f ON concat('x-and-Fandom-', CAST(p.fandom_id_a - 100 AS VARCHAR), '-and-', p.slug_b, '-and-Fandom-', CAST(p.fandom_id_b - 100 AS VARCHAR)) LIKE concat('%-and-', f.fandom_slug)")(
    lambda c: ingest.tail_matches(c("pairs").withColumn("mangled", F.format_string("x-and-Fandom-%d-and-%s-and-Fandom-%d", F.col("fandom_id_a") - 100, "slug_b", F.col("fandom_id_b") - 100)), "mangled", c("fandoms").select("id", "fandom_slug"), "fandom_slug").select("fandom_id_a", "fandom_id_b", "id")
)
query("F25_prefix", "SELECT surface_key FROM crawl_state WHERE surface_key LIKE 'browse:%'")(lambda c: c("crawl_state").filter(F.col("surface_key").startswith("browse:")).select("surface_key"))
query("F26_stale", f"SELECT story_id FROM stories_base WHERE last_seen_at < {TS} - INTERVAL '180' DAY")(lambda c: c.stories.filter(ingest.stale()).select("story_id"))
query("F27_canonical_pairs", "SELECT DISTINCT l_suppkey % 40 AS fandom_id_a, l_partkey % 40 AS fandom_id_b FROM lineitem WHERE l_suppkey % 40 < l_partkey % 40")(
    lambda c: ingest.canonical_pairs(c("lineitem").select((F.col("l_suppkey") % 40).alias("fandom_id_a"), (F.col("l_partkey") % 40).alias("fandom_id_b")))
)
query("F28_listing_validity", "SELECT story_id FROM stories_base WHERE story_id % 3 <> 0")(
    lambda c: listing.listing_rows(rendered(c.stories).select(F.when(F.col("story_id") % 3 == 0, F.replace("html", F.lit('href="/u/'), F.lit('href="/v/'))).otherwise(F.col("html")).alias("html"))).select("story_id")
)

# --- joins


@query("J03_shortlist_join", "SELECT s.story_id, s.title FROM stories_base s JOIN (SELECT story_id FROM live ORDER BY favorite_count DESC, story_id DESC LIMIT 500) x ON x.story_id = s.story_id")
def _(c: Corpus) -> DataFrame:
    best = analytics.live(c.stories).orderBy(F.col("favorite_count").desc(), F.col("story_id").desc()).limit(500).select("story_id")  # at most 500 ids
    return c.stories.join(F.broadcast(best), "story_id").select("story_id", "title")


query("J02_bridge_names", "SELECT b.story_id, f.name FROM story_fandoms b JOIN fandoms f ON f.id = b.fandom_id")(lambda c: c("story_fandoms").join(c("fandoms").select(F.col("id").alias("fandom_id"), "name"), "fandom_id").select("story_id", "name"))
query("J04_facet_join", "SELECT f.name AS value, count(*) AS count FROM story_fandoms b JOIN fandoms f ON f.id = b.fandom_id JOIN live s ON s.story_id = b.story_id GROUP BY f.name")(
    lambda c: analytics.facets(c.stories, c("story_fandoms"), c("fandoms")).filter("facet = 'fandoms'").select("value", "count")
)
PENDING_PAIRS = """SELECT p.fandom_id_a, p.fandom_id_b, coalesce(fa.fandom_slug, p.slug_a) AS slug_a, coalesce(fb.fandom_slug, p.slug_b) AS slug_b FROM pairs p
LEFT JOIN crawl_state s ON s.surface_key = concat('crossover:', CAST(p.fandom_id_a AS VARCHAR), '/', CAST(p.fandom_id_b AS VARCHAR)) LEFT JOIN fandoms fa ON fa.category_id = p.fandom_id_a LEFT JOIN fandoms fb ON fb.category_id = p.fandom_id_b
WHERE s.is_exhausted IS NOT TRUE ORDER BY 1, 2"""
PENDING_FANDOMS = """SELECT f.id, f.name, f.story_count, s.last_page FROM fandoms f LEFT JOIN crawl_state s ON s.surface_key = concat('browse:', f.section_slug, '/', f.fandom_slug)
WHERE f.section_slug IS NOT NULL AND f.fandom_slug IS NOT NULL AND s.is_exhausted IS NOT TRUE ORDER BY f.story_count NULLS LAST, f.name"""
query("J05_pairs_state_join", PENDING_PAIRS)(lambda c: analytics.pending_pairs(c("pairs"), c("crawl_state"), c("fandoms")))
query("Q02_pending_pairs", f"{PENDING_PAIRS} LIMIT 25")(lambda c: analytics.pending_pairs(c("pairs"), c("crawl_state"), c("fandoms"), 25))
query("O08_pair_order", f"{PENDING_PAIRS} LIMIT 7")(lambda c: analytics.pending_pairs(c("pairs"), c("crawl_state"), c("fandoms"), 7))
query("J06_fandoms_state_join", PENDING_FANDOMS)(lambda c: analytics.pending_fandoms(c("fandoms"), c("crawl_state")).select("id", "name", "story_count", "last_page"))
query("Q01_pending_fandoms", f"{PENDING_FANDOMS} LIMIT 25")(lambda c: analytics.pending_fandoms(c("fandoms"), c("crawl_state"), 25).select("id", "name", "story_count", "last_page"))
query("O07_queue_order", f"{PENDING_FANDOMS} LIMIT 5")(lambda c: analytics.pending_fandoms(c("fandoms"), c("crawl_state"), 5).select("id", "name", "story_count", "last_page"))
query("J07_unnest_genres", "SELECT story_id, g AS genre FROM (SELECT story_id, unnest(genres) AS g FROM live) x")(lambda c: analytics.live(c.stories).select("story_id", F.explode("genres").alias("genre")))
query("J08_group_label", f"SELECT story_id, {SHIP} AS ship FROM (SELECT story_id, unnest(ships) AS g FROM live) x")(lambda c: analytics.live(c.stories).select("story_id", F.explode("ships").alias("g")).select("story_id", analytics.ship_label(F.col("g")).alias("ship")))
query("J09_exists_in_group", "SELECT story_id FROM live WHERE len(list_filter(ships, lambda g: list_contains(g, 'Crowley'))) > 0")(lambda c: analytics.live(c.stories).filter(F.exists("ships", lambda g: F.array_contains(g, "Crowley"))).select("story_id"))
query("J10_self_semi_theta", "SELECT n_nationkey FROM nation a WHERE EXISTS (SELECT 1 FROM nation b WHERE b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey AND b.n_name LIKE concat('%', substr(a.n_name, length(a.n_name), 1)))")(
    lambda c: c("nation").alias("a").join(c("nation").alias("b"), F.expr("b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey AND b.n_name LIKE concat('%', substr(a.n_name, length(a.n_name), 1))"), "left_semi").select("n_nationkey")
)


@query("J11_duplicate_ids", "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)")
def _(c: Corpus) -> DataFrame:
    return ingest.repeated(c("orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey")


def shared_fandoms(c: Corpus) -> DataFrame:
    """Fandoms with orphans: every unslugged one gets the category of a slugged one."""
    return c("fandoms").withColumn("category_id", F.when(F.col("section_slug").isNull(), F.col("category_id") - F.when(F.col("id") % 8 == 3, 1).otherwise(0)).otherwise(F.col("category_id")))


SHARED = "shared AS (SELECT id, name, section_slug, fandom_slug, CASE WHEN section_slug IS NULL AND id % 8 = 3 THEN category_id - 1 ELSE category_id END AS category_id, story_count FROM fandoms)"
MOVED = "moved AS (SELECT o.id AS fandom_id, r.id AS to_id FROM shared o JOIN shared r ON r.category_id = o.category_id AND r.section_slug IS NOT NULL WHERE o.section_slug IS NULL)"


@query("J12_orphan_remap", f"WITH {SHARED}, {MOVED} SELECT DISTINCT b.story_id, coalesce(m.to_id, b.fandom_id) AS fandom_id FROM story_fandoms b LEFT JOIN moved m ON m.fandom_id = b.fandom_id")
def _(c: Corpus) -> DataFrame:
    return ingest.repair_identity(shared_fandoms(c), c("story_fandoms"), c("pairs"))[1].select("story_id", "fandom_id")


@query("M09_identity_repair", f"WITH {SHARED}, {MOVED} SELECT id, CASE WHEN section_slug IS NULL THEN concat('FFN category ', CAST(category_id AS VARCHAR)) ELSE name END AS name, fandom_slug, category_id FROM shared WHERE id NOT IN (SELECT fandom_id FROM moved)")
def _(c: Corpus) -> DataFrame:
    return ingest.repair_identity(shared_fandoms(c), c("story_fandoms"), c("pairs"))[0].select("id", "name", "fandom_slug", "category_id")


query("J13_anti_join", "SELECT f.id FROM fandoms f WHERE NOT EXISTS (SELECT 1 FROM crawl_state s WHERE s.surface_key = concat('browse:', f.section_slug, '/', f.fandom_slug))")(
    lambda c: c("fandoms").withColumn("surface_key", F.concat(F.lit("browse:"), "section_slug", F.lit("/"), "fandom_slug")).join(c("crawl_state"), "surface_key", "left_anti").select("id")
)
query("J14_update_from", "SELECT p.fandom_id_a, p.fandom_id_b, coalesce(f.fandom_slug, p.slug_b) AS slug_b FROM pairs p LEFT JOIN fandoms f ON f.category_id = p.fandom_id_b")(
    lambda c: ingest.repair_identity(c("fandoms"), c("story_fandoms"), c("pairs"))[2].select("fandom_id_a", "fandom_id_b", "slug_b")
)


@query("J15_slug_lookup", "SELECT p.fandom_id_a, p.fandom_id_b, a.fandom_slug AS slug_a, b.fandom_slug AS slug_b FROM pairs p LEFT JOIN fandoms a ON a.category_id = p.fandom_id_a LEFT JOIN fandoms b ON b.category_id = p.fandom_id_b")
def _(c: Corpus) -> DataFrame:
    return ingest.add_pairs(c("pairs").limit(0), c("pairs"), c("fandoms")).select("fandom_id_a", "fandom_id_b", "slug_a", "slug_b")


query("J16_pair_dedupe", "SELECT DISTINCT least(l_suppkey, l_partkey) AS fandom_id_a, greatest(l_suppkey, l_partkey) AS fandom_id_b FROM lineitem WHERE l_suppkey <> l_partkey")(
    lambda c: ingest.canonical_pairs(c("lineitem").select(F.least("l_suppkey", "l_partkey").alias("fandom_id_a"), F.greatest("l_suppkey", "l_partkey").alias("fandom_id_b")))
)

# --- aggregates

query("A01_count", "SELECT count(*) AS n FROM live")(lambda c: analytics.live(c.stories).agg(F.count("*").alias("n")))
query("A02_count_distinct", "SELECT count(DISTINCT author_id) AS authors, count(DISTINCT language) AS languages FROM live")(lambda c: analytics.live(c.stories).agg(F.countDistinct("author_id").alias("authors"), F.countDistinct("language").alias("languages")))
query("A03_filtered_counts", f"SELECT count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE {ABANDONED}) AS abandoned, count(*) FILTER (WHERE len(ships) > 0) AS with_ships, count(*) FILTER (WHERE is_crossover) AS crossovers FROM live")(
    lambda c: analytics.stats(c.stories).select("complete", "abandoned", "with_ships", "crossovers")
)
query("A04_sum_words", "SELECT CAST(coalesce(sum(word_count), 0) AS BIGINT) AS total_words FROM live")(lambda c: analytics.stats(c.stories).select("total_words"))
query("A05_date_range", "SELECT CAST(CAST(min(published_at) AS DATE) AS VARCHAR) AS earliest, CAST(CAST(max(published_at) AS DATE) AS VARCHAR) AS latest FROM live")(lambda c: analytics.stats(c.stories).select("earliest", "latest"))
FACETS = f"""SELECT 'fandoms' AS facet, f.name AS value, count(*) AS count FROM story_fandoms b JOIN fandoms f ON f.id = b.fandom_id JOIN live s ON s.story_id = b.story_id GROUP BY f.name
UNION ALL SELECT 'genres', g, count(*) FROM (SELECT unnest(genres) AS g FROM live) x GROUP BY g UNION ALL SELECT 'characters', g, count(*) FROM (SELECT unnest(characters) AS g FROM live) x GROUP BY g
UNION ALL SELECT 'languages', language, count(*) FROM live WHERE language IS NOT NULL GROUP BY language UNION ALL SELECT 'ratings', rating, count(*) FROM live WHERE rating IS NOT NULL GROUP BY rating
UNION ALL SELECT 'ships', {SHIP}, count(*) FROM (SELECT unnest(ships) AS g FROM live) x GROUP BY 2"""
query("A06_facet_counts", FACETS)(lambda c: analytics.facets(c.stories, c("story_fandoms"), c("fandoms")))
REGISTRY["U01_union_of_facets"] = REGISTRY["A06_facet_counts"]
LEADERS = f"SELECT {SHIP} AS ship, count(*) AS stories, CAST(sum(word_count) AS BIGINT) AS total_words, round(avg(favorite_count)) AS avg_favorites FROM (SELECT unnest(ships) AS g, word_count, favorite_count FROM live) x GROUP BY 1"
query("A07_ship_aggregates", LEADERS)(lambda c: analytics.ship_aggregates(c.stories))
query("A08_ordered_string_agg", "SELECT story_id, (SELECT string_agg(m, ' / ' ORDER BY m) FROM (SELECT unnest(ships[1]) AS m) y) AS ship FROM live WHERE len(ships) > 0")(lambda c: analytics.live(c.stories).filter(F.size("ships") > 0).select("story_id", analytics.ship_label(F.col("ships")[0]).alias("ship")))
REGISTRY["A09_ordered_array_agg"] = REGISTRY["P03_fandom_names"]
query("A10_capped_count", "SELECT count(*) AS total FROM (SELECT 1 FROM lineitem WHERE l_quantity > 10 LIMIT 10000) x")(lambda c: search.capped_count(c("lineitem").filter("l_quantity > 10")))
query("A11_distinct_members", "SELECT story_id, len(list_distinct(list_intersect(ships[1], ['Crowley', 'Aziraphale', 'Harry P.'])))::INT AS members FROM live WHERE len(ships) > 0")(
    lambda c: analytics.live(c.stories).filter(F.size("ships") > 0).select("story_id", F.size(F.array_intersect(F.col("ships")[0], F.array(F.lit("Crowley"), F.lit("Aziraphale"), F.lit("Harry P.")))).alias("members"))
)
query("A12_survivors", "SELECT c_nationkey AS category_id, min(c_custkey) AS id FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1")(lambda c: c("customer").filter(F.col("c_nationkey").isNotNull()).groupBy(F.col("c_nationkey").alias("category_id")).agg(F.min("c_custkey").alias("id")))
query("A13_text_bytes", "SELECT CAST(sum(strlen(summary) + strlen(title)) AS BIGINT) AS text_bytes FROM live")(lambda c: analytics.corpus_shape(c.stories).select("text_bytes"))
query("A14_progress", "SELECT (SELECT count(*) FROM stories WHERE deleted_at IS NULL) AS stories, (SELECT count(summary_embedding) FROM stories WHERE deleted_at IS NULL) AS embedded, (SELECT count(*) FROM crawl_state WHERE surface_key LIKE 'browse:%' AND is_exhausted) AS exhausted, (SELECT count(*) FROM crawl_state WHERE surface_key LIKE 'browse:%') AS surfaces")(
    lambda c: analytics.progress(c.embedded, c("crawl_state"))
)
query("A15_pending_counts", "SELECT (SELECT count(*) FROM stories WHERE deleted_at IS NULL AND summary_embedding IS NULL) AS unembedded, (SELECT count(*) FROM pairs) AS pairs")(
    lambda c: analytics.live(c.embedded).agg(F.count_if(F.col("summary_embedding").isNull()).alias("unembedded")).crossJoin(c("pairs").agg(F.count("*").alias("pairs")))
)
REGISTRY["Q03_unembedded"] = REGISTRY["A15_pending_counts"]
query("A17_sample_statistics", "SELECT list_sort(list(c_nationkey))[CAST(floor(count(*) / 2.0) AS INT) + 1] AS median, round(avg(c_nationkey), 6) AS mean, max(c_nationkey) AS largest, round(avg(c_nationkey) * 97348, 3) AS predicted FROM customer")(
    lambda c: analytics.sample_statistics(c("customer"), "c_nationkey", 97348)
)
query("A18_directory_totals", "SELECT section_slug, count(*) AS fandoms, CAST(sum(story_count) AS BIGINT) AS stories FROM fandoms WHERE section_slug IS NOT NULL GROUP BY ROLLUP (section_slug)")(lambda c: analytics.directory_totals(c("fandoms")))
query("A19_page_count", "SELECT s_suppkey, CAST(greatest(s_suppkey, s_nationkey) AS INT) AS pages FROM supplier")(
    lambda c: c("supplier").select("s_suppkey", listing.page_count(F.concat(F.lit("<a href='?p="), F.format_number("s_suppkey", 0), F.lit("'>x</a><a href='/b/?srt=1&p="), F.col("s_nationkey").cast("string"), F.lit("'>y</a>"))).alias("pages"))
)
query("A16_accumulated_rows", "SELECT user_id, count(*) AS rows_ingested FROM events GROUP BY user_id")(lambda c: c("events").groupBy("user_id").agg(F.sum(F.lit(1)).alias("rows_ingested")))

query("N09_progress_line", "SELECT concat(CAST(count(*) AS VARCHAR), ' stories, ', CAST(count(summary_embedding) AS VARCHAR), ' embedded, ', (SELECT concat(CAST(count(*) FILTER (WHERE is_exhausted) AS VARCHAR), '/', CAST(count(*) AS VARCHAR)) FROM crawl_state WHERE surface_key LIKE 'browse:%'), ' surfaces') AS line FROM stories WHERE deleted_at IS NULL")(
    lambda c: analytics.progress(c.embedded, c("crawl_state")).select(F.format_string("%d stories, %d embedded, %d/%d surfaces", "stories", "embedded", "exhausted", "surfaces").alias("line"))
)
query("X26_durations", "SELECT event_id, CASE WHEN s >= 86400 THEN concat(CAST(s // 86400 AS VARCHAR), 'd ', CAST(s % 86400 // 3600 AS VARCHAR), 'h') ELSE printf('%.1fh', s % 86400 / 3600.0) END AS spent FROM (SELECT event_id, CAST(event_id * 900 AS BIGINT) AS s FROM events) x")(
    lambda c: c("events").select("event_id", analytics.duration(F.col("event_id") * 900).alias("spent"))
)
query(
    "N12_anomalies",
    "SELECT count(*) FILTER (WHERE rating IS NULL) AS no_rating, count(*) FILTER (WHERE language IS NULL) AS no_language, count(*) FILTER (WHERE word_count IS NULL) AS no_words, count(*) FILTER (WHERE published_at IS NULL) AS no_date, count(*) FILTER (WHERE updated_at < published_at) AS dates_reversed, "
    "count(*) FILTER (WHERE len(genres) > 2) AS many_genres, count(*) FILTER (WHERE coalesce(trim(title), '') = '') AS no_title, count(*) FILTER (WHERE regexp_matches(summary, '<[A-Za-z/]')) AS markup, "
    f"count(*) FILTER (WHERE len(list_filter(genres, lambda g: NOT list_contains({list(GENRES)}, g))) > 0) AS unknown_genre, count(*) FILTER (WHERE len(list_filter(characters, lambda x: regexp_matches(x, '{analytics.COUNT_LIKE}'))) > 0) AS count_as_character FROM live",
)(lambda c: analytics.anomalies(c.stories).select("no_rating", "no_language", "no_words", "no_date", "dates_reversed", "many_genres", "no_title", "markup", "unknown_genre", "count_as_character"))
query("S04_firehose", "SELECT story_id, concat('https://www.fanfiction.net/s/', CAST(story_id AS VARCHAR), '/1/') AS url FROM live ORDER BY updated_at DESC NULLS LAST, story_id DESC LIMIT 100")(
    lambda c: search.search(c.stories, SearchFilters(sort="updated", page_size=surfaces.ROWS_PER_PAGE["firehose"])).select("story_id", surfaces.story_url(F.col("story_id"), F.lit(1)).alias("url"))
)
PROBES = {
    "everything": ({}, "true"),
    "complete": ({"status": "complete"}, "status = 'complete'"),
    "abandoned": ({"only_abandoned": True}, ABANDONED),
    "not abandoned": ({"exclude_abandoned": True}, f"NOT {ABANDONED}"),
    "Humor": ({"genres": ["Humor"]}, "list_contains(genres, 'Humor')"),
    "Humor, not Romance": ({"genres": ["Humor"], "excluded_genres": ["Romance"]}, "list_contains(genres, 'Humor') AND NOT list_contains(genres, 'Romance')"),
    "Aziraphale": ({"characters": ["Aziraphale"]}, "list_contains(characters, 'Aziraphale')"),
    "Aziraphale, not OC": ({"characters": ["Aziraphale"], "excluded_characters": ["OC"]}, "list_contains(characters, 'Aziraphale') AND NOT list_contains(characters, 'OC')"),
    "a pair": ({"ship": ["Crowley", "Aziraphale"]}, "len(list_filter(ships, lambda g: list_contains(g, 'Crowley') AND list_contains(g, 'Aziraphale'))) > 0"),
    "long and liked": ({"min_words": 10_000, "status": "complete", "min_favorites": 50}, "word_count >= 10000 AND status = 'complete' AND favorite_count >= 50"),
    "French": ({"languages": ["fr"]}, "language = 'fr'"),
    "a word": ({"query": "with"}, "regexp_matches(lower(concat(title, ' ', author_name, ' ', summary)), '(^|[^\\p{L}\\p{N}])with([^\\p{L}\\p{N}]|$)')"),
    "an author": ({"query": "author"}, "regexp_matches(lower(concat(title, ' ', author_name, ' ', summary)), '(^|[^\\p{L}\\p{N}])author([^\\p{L}\\p{N}]|$)')"),
}
query("N13_smoke_probes", " UNION ALL ".join(f"SELECT '{k}' AS probe, count(*) FILTER (WHERE {w}) AS stories FROM live" for k, (_, w) in PROBES.items()))(
    lambda c: search.probes(c.stories, {k: SearchFilters(**f) for k, (f, _) in PROBES.items()})
)

# --- order and limits

for _name, _column in (("updated", "updated_at"), ("published", "published_at"), ("favorites", "favorite_count"), ("reviews", "review_count"), ("follows", "follow_count"), ("words", "word_count"), ("favorites_per_1k", RATIO)):
    query(f"O{'02' if _name in ('favorites', 'reviews', 'follows') else '01'}_sort_{_name}", f"SELECT story_id, favorite_count FROM live ORDER BY {_column} DESC NULLS LAST, story_id DESC LIMIT 25")(
        lambda c, sort=_name: search.search(c.stories, SearchFilters(sort=sort)).select("story_id", "favorite_count")
    )
query("O03_relevance_fallback", "SELECT story_id FROM live ORDER BY updated_at DESC NULLS LAST, story_id DESC LIMIT 25")(lambda c: search.search(c.stories, SearchFilters(sort="relevance")).select("story_id"))
query("O04_semantic_fallback", "SELECT story_id FROM live ORDER BY updated_at DESC NULLS LAST, story_id DESC LIMIT 25")(lambda c: search.search(c.stories, SearchFilters(sort="semantic")).select("story_id"))
query("O05_page", "SELECT story_id FROM live ORDER BY word_count DESC NULLS LAST, story_id DESC LIMIT 10 OFFSET 20")(lambda c: search.search(c.stories, SearchFilters(sort="words", page=3, page_size=10)).select("story_id"))
LIMITED = "SELECT facet, value, count FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) AS n FROM ({f}) y) z WHERE n <= CASE facet WHEN 'fandoms' THEN 200 WHEN 'genres' THEN 50 WHEN 'characters' THEN 300 WHEN 'languages' THEN 50 WHEN 'ratings' THEN 10 ELSE 100 END".replace("{f}", FACETS)
query("N02_facets", LIMITED)(lambda c: analytics.top_facets(analytics.facets(c.stories, c("story_fandoms"), c("fandoms"))))
query("O06_facet_top_n", LIMITED.replace("WHEN 'genres' THEN 50", "WHEN 'genres' THEN 3"))(lambda c: analytics.top_facets(analytics.facets(c.stories, c("story_fandoms"), c("fandoms")), analytics.FACET_LIMITS | {"genres": 3}))
query("O09_embed_batch", "SELECT story_id FROM stories WHERE deleted_at IS NULL AND summary_embedding IS NULL ORDER BY story_id LIMIT 32")(lambda c: analytics.live(c.embedded).filter(F.col("summary_embedding").isNull()).orderBy("story_id").limit(32).select("story_id"))
query("O11_top_20", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 20")(lambda c: analytics.top(c("part"), F.col("p_retailprice").desc(), F.col("p_partkey").desc()).select("p_partkey", "p_retailprice"))
query("O12_stride_sample", "SELECT n_nationkey, n_name FROM (SELECT *, row_number() OVER (ORDER BY n_name) AS n FROM nation) x WHERE (n - 1) % 3 = 0 ORDER BY n LIMIT 16")(lambda c: analytics.stride_sample(c("nation"), "n_name", 3).select("n_nationkey", "n_name"))
query("U02_set_dedupe", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")(lambda c: c("orders").select("o_custkey", "o_orderpriority").distinct())

# --- scalar functions


@query("X01_strip_tags", "SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '<[^>]+>', '', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')) AS heading FROM pages")
def _(c: Corpus) -> DataFrame:
    return c("pages").select("page_id", listing.strip_tags(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("heading"))


X_FIELDS = {
    "X02_genres": ("genres", "array_to_string(genres, '|')"),
    "X03_characters": ("characters", "array_to_string(characters, '|')"),
    "X08_counts": (("chapter_count", "word_count", "review_count", "favorite_count", "follow_count"), None),
    "X09_rating": ("rating", "coalesce(rating, '')"),
    "X06_fandom_prefix": ("fandom_names", "CASE WHEN is_crossover THEN 'Alpha|Beta' ELSE '' END"),
    "X04_to_utc": ("published_at", "CAST(published_at AS VARCHAR)"),
    "X05_date_labels": ("updated_at", "CAST(coalesce(updated_at, published_at) AS VARCHAR)"),
    "X07_meta_line": (("language", "status", "is_crossover"), None),
}
for _name, (_fields, _sql) in X_FIELDS.items():
    _own = (_fields,) if isinstance(_fields, str) else _fields
    # characters of a story are its ship members first, as a listing shows them
    _select = f"{_sql} AS {_fields}" if _sql else ", ".join(_own)
    query(_name, f"SELECT story_id, {_select} {RATED}")(lambda c, own=_own: parsed(c).select("story_id", *own))
query("X10_abbreviated", "SELECT s_suppkey, CAST(CASE s_suppkey % 3 WHEN 0 THEN s_suppkey * 1000 WHEN 1 THEN s_suppkey * 1000000 ELSE s_suppkey END AS BIGINT) AS n FROM supplier")(
    lambda c: c("supplier").select("s_suppkey", listing.abbreviated(F.col("s_suppkey").cast("string"), F.element_at(F.array(F.lit("K"), F.lit("M"), F.lit("")), (F.col("s_suppkey") % 3 + 1).cast("int"))).alias("n"))
)
query("X11_listing_row", f"SELECT story_id, author_id, CAST(word_count AS BIGINT) AS words, language, status {RATED}")(lambda c: parsed(c).select("story_id", "author_id", F.col("word_count").cast("long").alias("words"), "language", "status"))
query("X12_fandom_directory", "SELECT DISTINCT name, 'book' AS section_slug, fandom_slug, CAST(story_count * 1000 AS BIGINT) AS story_count FROM fandoms WHERE section_slug = 'book'")(
    lambda c: listing.fandom_directory(
        c("fandoms").filter("section_slug = 'book'").select(F.concat(F.lit('<a href="/book/'), "fandom_slug", F.lit('/" title="x">'), "name", F.lit("</a>"), F.coalesce(F.concat(F.lit(" <SPAN CLASS='gray'>("), F.col("story_count").cast("string"), F.lit("K)</SPAN>")), F.lit(""))).alias("html")), "book"
    )
)
query("X13_crossover_directory", "SELECT name, fandom_slug, category_id FROM fandoms WHERE fandom_slug IS NOT NULL")(
    lambda c: listing.crossover_directory(c("fandoms").filter("fandom_slug IS NOT NULL").select(F.concat(F.lit('<div><a href="/crossovers/'), "fandom_slug", F.lit("/"), F.col("category_id").cast("string"), F.lit('/" title="t">'), "name", F.lit("</a></div>")).alias("html")))
)
query("X13_crossover_pairs", "SELECT fandom_id_a, fandom_id_b, slug_b AS slug FROM pairs")(
    lambda c: listing.crossover_pairs(c("pairs").select(F.concat(F.lit('<a href="/'), "slug_b", F.lit("-Crossovers/"), F.col("fandom_id_a").cast("string"), F.lit("/"), F.col("fandom_id_b").cast("string"), F.lit('/">x</a>')).alias("html")))
)
REGISTRY["X14_page_count"] = REGISTRY["A19_page_count"]
query("X15_interval", f"SELECT o_orderkey, o_orderdate < TIMESTAMP '2000-02-29' - INTERVAL '2' YEAR AS old FROM orders")(lambda c: c("orders").select("o_orderkey", (F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '2000-02-29 00:00:00' - INTERVAL '2' YEAR")).alias("old")))
query("X16_whole_years", f"SELECT story_id, CAST(date_part('year', age({TS}, published_at)) AS INT) AS years, CAST(CAST(date_trunc('day', published_at) AS DATE) AS VARCHAR) AS day FROM stories_base")(
    lambda c: c.stories.select("story_id", analytics.whole_years(F.lit(AS_OF).cast("timestamp"), F.col("published_at")).alias("years"), F.to_date(F.date_trunc("day", "published_at")).alias("day"))
)
query("X17_round_half_up", "SELECT l_orderkey, l_linenumber, round(CAST(l_quantity AS DECIMAL(18,4)) / 8, 2)::DOUBLE AS r FROM lineitem")(lambda c: c("lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity").cast("decimal(18,4)") / 8, 2).alias("r")))
query("X18_coalesce_case", "SELECT story_id, coalesce(rating, 'none') AS rating, CASE WHEN word_count > 0 THEN 'some' ELSE 'none' END AS words FROM stories_base")(lambda c: c.stories.select("story_id", F.coalesce("rating", F.lit("none")).alias("rating"), F.when(F.col("word_count") > 0, "some").otherwise("none").alias("words")))
query("X19_surface_keys", "SELECT concat('crossover:', CAST(fandom_id_a AS VARCHAR), '/', CAST(fandom_id_b AS VARCHAR)) AS k FROM pairs")(lambda c: c("pairs").select(F.format_string("crossover:%d/%d", "fandom_id_a", "fandom_id_b").alias("k")))
query("X20_json_groups", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(lambda c: c("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
query("X21_ships_json", "SELECT story_id, replace(CAST(to_json(ships) AS VARCHAR), ' ', '') AS ships FROM stories_base")(lambda c: c.stories.select("story_id", F.replace(F.to_json("ships"), F.lit(" "), F.lit("")).alias("ships")))
query("X22_default_names", "SELECT id, replace(fandom_slug, '-', ' ') AS name FROM fandoms")(lambda c: c("fandoms").select("id", surfaces.default_name(F.col("fandom_slug")).alias("name")))
query("X23_url_encode", "SELECT id, concat('x=', replace(name, ' ', '+')) AS q FROM fandoms")(lambda c: c("fandoms").select("id", F.concat(F.lit("x="), F.url_encode("name")).alias("q")))
query("X24_placeholder", "SELECT id, concat('FFN category ', CAST(category_id AS VARCHAR)) AS name FROM fandoms")(lambda c: c("fandoms").select("id", surfaces.placeholder_name(F.col("category_id")).alias("name")))
query("X25_abandoned_days", f"SELECT story_id, status = 'in_progress' AND coalesce(date_diff('day', updated_at, {TS}) > 730, false) AS abandoned FROM stories_base")(lambda c: c.stories.select("story_id", is_abandoned_by_days().alias("abandoned")))
query("X28_ship_string", f"SELECT story_id, {SHIP} AS ship, len(string_split({SHIP}, ' / '))::INT AS n FROM (SELECT story_id, unnest(ships) AS g FROM live) x")(
    lambda c: analytics.live(c.stories).select("story_id", F.explode("ships").alias("g")).select("story_id", analytics.ship_label(F.col("g")).alias("ship")).withColumn("n", F.size(F.split("ship", " / ")))
)

# --- full text and vectors

Q64 = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
NEAR = "list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (summary_embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END))::INT"
COS = "list_cosine_distance(summary_embedding::DOUBLE[], list_transform(q::DOUBLE[], lambda x: round(x, 6)))"
QUERY_VECTOR = f"(SELECT s.*, {Q64} AS q FROM stories s WHERE deleted_at IS NULL AND summary_embedding IS NOT NULL"


def _near(c: Corpus) -> DataFrame:
    return filtered(c.embedded, SearchFilters(vector=c.query_vector))


@query("V01_hamming", f"SELECT story_id, {NEAR} AS hamming FROM {QUERY_VECTOR}) x")
def _(c: Corpus) -> DataFrame:
    return _near(c).select("story_id", vectors.hamming(sign_bits(F.col("summary_embedding")), vectors.query_bits(vectors.rounded(c.query_vector))).cast("int").alias("hamming"))


@query("V02_cosine", f"SELECT story_id, round({COS}, 6) AS distance FROM {QUERY_VECTOR}) x")
def _(c: Corpus) -> DataFrame:
    return _near(c).select("story_id", F.round(vectors.cosine_distance(F.col("summary_embedding"), vectors.rounded(c.query_vector)), 6).alias("distance"))


TWO_PHASE = f"SELECT story_id FROM (SELECT story_id, round({COS}, 12) AS d FROM {QUERY_VECTOR} AND status = 'in_progress') x QUALIFY row_number() OVER (ORDER BY {NEAR} ASC, story_id DESC) <= 500) y ORDER BY d, story_id DESC LIMIT 25"


@query("V03_two_phase", TWO_PHASE)
def _(c: Corpus) -> DataFrame:
    return search.search(c.embedded, SearchFilters(vector=c.query_vector, sort="semantic", status="in_progress")).select("story_id")


REGISTRY["N01_semantic_search"] = REGISTRY["V03_two_phase"]
query("O10_hamming_shortlist", f"SELECT story_id FROM {QUERY_VECTOR}) x ORDER BY {NEAR} ASC, story_id DESC LIMIT 500")(lambda c: search.shortlist(_near(c), SearchFilters(vector=c.query_vector)).select("story_id"))
query("V06_width_check", "SELECT vec_id, len(embedding)::INT AS dims FROM embeddings")(lambda c: c("embeddings").select("vec_id", F.size(vectors.checked_width(F.col("embedding"), 64)).alias("dims")))
query("V05_rounded_vector", "SELECT vec_id, i::INT AS i, round(embedding[i + 1]::DOUBLE, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS i FROM embeddings) y")(lambda c: c("embeddings").select("vec_id", F.posexplode(vectors.rounded_column(F.col("embedding"))).alias("i", "x")))
query("T01_stemmed_tokens", None)(lambda c: fulltext.with_document(c.stories, stemmed=True).select("story_id", F.array_join("doc_a", " ").alias("title_tokens"), F.size("doc_c").alias("n")))
query("T02_web_query", None)(lambda c: filtered(c.stories, SearchFilters(query='"licensed under" or released -apache', stemmed=True)).select("story_id"))
WORD = "lambda w: w IN ('the', 'of')"
TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')"
RANK = " + ".join(f"len(list_filter({TOK.format(c=c)}, {WORD})) * {w}" for c, w in (("title", 1.0), ("author_name", 0.4), ("summary", 0.2)))
query("T03_rank", f"SELECT story_id, round(CAST({RANK} AS DOUBLE), 6) AS rank FROM live")(lambda c: fulltext.with_document(analytics.live(c.stories)).select("story_id", fulltext.rank("the of").alias("rank")))
query("N01_text_search", f"SELECT story_id FROM (SELECT story_id, round(CAST({RANK} AS DOUBLE), 6) AS rank FROM live WHERE regexp_matches(concat(' ', array_to_string(regexp_extract_all(lower(concat(title, ' ', author_name, ' ', summary)), '[\\p{{L}}\\p{{N}}]+'), ' '), ' '), ' the ') AND regexp_matches(concat(' ', array_to_string(regexp_extract_all(lower(concat(title, ' ', author_name, ' ', summary)), '[\\p{{L}}\\p{{N}}]+'), ' '), ' '), ' of ')) x ORDER BY rank DESC, story_id DESC LIMIT 25")(
    lambda c: search.search(c.stories, SearchFilters(query="the of", sort="relevance")).select("story_id")
)
# the same searches from the inverted table
query("N01_text_search_indexed", REGISTRY["N01_text_search"][1])(lambda c: textindex.search(c.stories, textindex.postings(c.stories), SearchFilters(query="the of", sort="relevance")).select("story_id"))
for _name, _query in (("F03_text_or_phrase", '"of the" or und'), ("F03_text_and", "with -this")):
    query(f"{_name}_indexed", REGISTRY[_name][1])(lambda c, q=_query: c.stories.join(textindex.matching(textindex.postings(c.stories), q), "story_id").select("story_id", "favorite_count"))
query(
    "T05_postings",
    f"SELECT term, count(*) AS stories, CAST(sum(n) AS BIGINT) AS places FROM (SELECT story_id, term, count(*) AS n FROM (SELECT story_id, unnest(list_concat({TOK.format(c='title')}, {TOK.format(c='author_name')}, {TOK.format(c='summary')})) AS term FROM live) x GROUP BY ALL) y GROUP BY term",
)(lambda c: textindex.postings(c.stories).groupBy("term").agg(F.count("*").alias("stories"), F.sum(F.size("a") + F.size("b") + F.size("c")).alias("places")))
GRAMS = "list_distinct(list_transform(range(1, len({p}) - 1), lambda i: substr({p}, CAST(i AS BIGINT), 3)))"
query(
    "T04_title_similarity",
    f"SELECT story_id, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS similarity FROM (SELECT story_id, {GRAMS.format(p='p')} AS a, {GRAMS.format(p='q')} AS b FROM (SELECT story_id, concat('  ', lower(title), ' ') AS p, '  the and ' AS q FROM stories_base) x) y",
)(lambda c: c.stories.select("story_id", F.round(fulltext.title_similarity(F.col("title"), "the and"), 6).alias("similarity")))


# similar texts from stored gram lists, and the best page from blocks with stored maxima


@query(
    "T04_similar_titles",
    f"SELECT story_id, round(s, 6) AS similarity FROM (SELECT story_id, len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) AS s FROM (SELECT story_id, {GRAMS.format(p='p')} AS a, {GRAMS.format(p='q')} AS b FROM (SELECT story_id, concat('  ', lower(title), ' ') AS p, (SELECT concat('  ', lower(title), ' ') FROM stories_base ORDER BY story_id LIMIT 1) AS q FROM stories_base) x) y) z WHERE s >= 0.3",
)
def _(c: Corpus) -> DataFrame:
    wanted = c.stories.orderBy("story_id").select("title").first().title  # a user's query: one row
    return gramindex.similar(gramindex.write_index(c.stories, scratch_path(c.spark, "grams")), wanted, 0.3)


query(
    "T04_similar_fandom_pairs",
    f"SELECT x.id AS id_a, y.id AS id_b, round(len(list_intersect(x.g, y.g)) / CAST(len(list_distinct(list_concat(x.g, y.g))) AS DOUBLE), 6) AS similarity FROM (SELECT id, {GRAMS.format(p='p')} AS g FROM (SELECT id, concat('  ', lower(name), ' ') AS p FROM fandoms) f) x JOIN (SELECT id, {GRAMS.format(p='p')} AS g FROM (SELECT id, concat('  ', lower(name), ' ') AS p FROM fandoms) f) y ON x.id < y.id WHERE len(list_intersect(x.g, y.g)) / CAST(len(list_distinct(list_concat(x.g, y.g))) AS DOUBLE) >= 0.7",
)(lambda c: gramindex.similar_pairs(c("fandoms"), 0.7, "id", "name"))


def by_blocks(c: Corpus, f: SearchFilters) -> DataFrame:
    """A search by an index of its own; small tables get ranges of fewer ids, about 64 of them."""
    span = min(topktext.SPAN, max(16, c("documents").count() // 64))
    return topktext.search(c.stories, topktext.write_index(c.stories, scratch_path(c.spark, "blocks"), span), f)


query("N01_text_topk_blocks", REGISTRY["N01_text_search"][1])(lambda c: by_blocks(c, SearchFilters(query="the of", sort="relevance")).select("story_id"))

# the nearest by sign bits from a stored index, whose radius grows until they are proven


def signed_search(c: Corpus, f: SearchFilters, k: int | None = None) -> DataFrame:
    """A search by an index of its own, with a folder of each chunk for about 100,000 vectors."""
    slot_bits = min(signindex.SLOT_BITS, max(2, (c("embeddings").count() // 100_000).bit_length()))
    return signindex.search(c.embedded, signindex.write_index(c.embedded, scratch_path(c.spark, "signs"), 64, slot_bits), f, k=k, slot_bits=slot_bits)


for _name, _k, _where, _filters in (("V04_nearest_signs", 5, "true", {}), ("V04_nearest_signs_filtered", 2, "status = 'in_progress'", {"status": "in_progress"})):
    query(_name, f"SELECT story_id, {NEAR} AS hamming FROM {QUERY_VECTOR} AND {_where}) x ORDER BY hamming ASC, story_id DESC LIMIT {_k}")(
        lambda c, k=_k, own=_filters: signed_search(c, SearchFilters(vector=c.query_vector, sort="semantic", **own), k).select("story_id", F.col("hamming").cast("int").alias("hamming"))
    )
query("V04_two_phase_indexed", TWO_PHASE)(lambda c: signed_search(c, SearchFilters(vector=c.query_vector, sort="semantic", status="in_progress")).select("story_id"))

# array filters from stored bitmaps


def by_bitmap(name: str, where: str, **filters) -> None:
    f = SearchFilters(**filters)
    query(f"{name}_bitmaps", f"SELECT story_id FROM live WHERE {where}")(lambda c: bitmaps.narrowed(c.stories, bitmaps.write_index(c.stories, scratch_path(c.spark, "bitmaps")), f).select("story_id"))


by_bitmap("F07_genre_overlap", "list_has_any(genres, ['Humor', 'Romance'])", genres=["Humor", "Romance"])
by_bitmap("F08_genre_exclude", "NOT list_has_any(genres, ['Romance', 'Horror'])", excluded_genres=["Romance", "Horror"])
by_bitmap("F09_character_overlap", "list_has_any(characters, ['OC', 'Ciel P.'])", characters=["OC", "Ciel P."])
by_bitmap("F10_character_exclude", "NOT list_has_any(characters, ['OC'])", excluded_characters=["OC"])
by_bitmap("F11_ship_one_group", "len(list_filter(ships, lambda g: len(list_distinct(list_intersect(g, ['Harry P.', 'Ginny W.']))) = 2)) > 0", ship=["Ginny W.", "Harry P.", "Harry P."])
INSIDE = SearchFilters(genres=["Romance", "Humor"], excluded_characters=["OC"])
INSIDE_SQL = "list_has_any(genres, ['Romance', 'Humor']) AND NOT list_has_any(characters, ['OC'])"


@query("N02_facets_inside_filter", f"SELECT 'genres' AS facet, g AS value, count(*) AS count FROM (SELECT unnest(genres) AS g FROM live WHERE {INSIDE_SQL}) x GROUP BY g UNION ALL SELECT 'characters', g, count(*) FROM (SELECT unnest(characters) AS g FROM live WHERE {INSIDE_SQL}) x GROUP BY g")
def _(c: Corpus) -> DataFrame:
    index = bitmaps.write_index(c.stories, scratch_path(c.spark, "bitmaps"))
    return bitmaps.facet_counts(index, bitmaps.matching(index, INSIDE))


# --- streams and state


def outcomes(c: Corpus) -> DataFrame:
    """A page log out of all orders: a surface for each 60 keys; the fourth page of some fails, the sixth of some is empty."""
    page, s = (F.col("o_orderkey") % 60 + 1).cast("int"), F.floor(F.col("o_orderkey") / 60)
    return c("orders").select(F.format_string("browse:book/s%d", s).alias("surface_key"), page.alias("page_no"), F.when((s % 5 == 1) & (page == 4), "error").otherwise("ok").alias("outcome"), F.when((s % 3 == 0) & (page == 6), 0).otherwise(25).cast("long").alias("rows"))


OUTCOMES = """outcomes AS (SELECT concat('browse:book/s', CAST(o_orderkey // 60 AS VARCHAR)) AS surface_key, CAST(o_orderkey % 60 + 1 AS INT) AS page_no,
CASE WHEN o_orderkey // 60 % 5 = 1 AND o_orderkey % 60 = 3 THEN 'error' ELSE 'ok' END AS outcome, CASE WHEN o_orderkey // 60 % 3 = 0 AND o_orderkey % 60 = 5 THEN 0 ELSE 25 END AS rows FROM orders)"""
WALK = f"""WITH {OUTCOMES}, numbered AS (SELECT *, row_number() OVER (PARTITION BY surface_key ORDER BY page_no) AS n FROM outcomes),
stops AS (SELECT surface_key, min(CASE WHEN outcome <> 'ok' OR rows = 0 OR page_no <> n THEN page_no END) AS stop FROM numbered GROUP BY 1)
SELECT n.surface_key, CAST(coalesce(max(CASE WHEN outcome = 'ok' AND rows > 0 AND page_no = n.n THEN page_no END), 0) AS INT) AS last_page, bool_or(outcome = 'ok' AND rows = 0) AS is_exhausted, CAST(sum(CASE WHEN outcome = 'ok' AND page_no = n.n THEN rows ELSE 0 END) AS BIGINT) AS rows_ingested,
max(CASE WHEN outcome <> 'ok' THEN outcome END) AS last_error FROM numbered n JOIN stops s ON s.surface_key = n.surface_key WHERE (stop IS NULL OR page_no <= stop) AND page_no = n.n GROUP BY 1"""
EMPTY_STATE = "surface_key string, last_page int, is_exhausted boolean, rows_ingested long"


@query("G02_resumable_walk", WALK)
def _(c: Corpus) -> DataFrame:
    return walk.walked(outcomes(c), c.spark.createDataFrame([], EMPTY_STATE)).select("surface_key", "last_page", "is_exhausted", "rows_ingested", "last_error")


@query("G02_stateful_walk", WALK)
def _(c: Corpus) -> DataFrame:
    """The same log as a stream in no order, each surface's state kept by its key; the stream ends half-way and goes on."""
    log, feed = outcomes(c).withColumn("fetched_at", F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) + F.col("page_no"))), scratch_path(c.spark, "outcomes")
    table = versions.VersionedTable(c.spark, scratch_path(c.spark, "walk"), "surface_key", 8)
    table.create(c.spark.createDataFrame([], crawl.PROGRESS))
    for turn in (0, 1):
        log.filter(F.pmod(F.xxhash64("surface_key", "page_no"), F.lit(2)) == turn).write.parquet(f"{feed}/turn={turn}")
        crawl.keep_progress(feeds.file_stream(c.spark, f"{feed}/turn=*", log.schema), f"{feed}-mark", table)
    return table.read().filter("last_page > 0").select("surface_key", "last_page", "is_exhausted", "rows_ingested", "last_error")


query("G03_refresh_head", f"WITH {OUTCOMES} SELECT surface_key, page_no FROM outcomes o WHERE page_no <= 20 AND page_no < coalesce((SELECT min(page_no) FROM outcomes e WHERE e.surface_key = o.surface_key AND e.rows = 0), 1000000)")(lambda c: walk.head_pages(outcomes(c)).select("surface_key", "page_no"))
query("G05_error_capture", f"WITH {OUTCOMES} SELECT surface_key, count(*) AS errors FROM outcomes WHERE outcome <> 'ok' GROUP BY 1")(lambda c: outcomes(c).filter("outcome <> 'ok'").groupBy("surface_key").agg(F.count("*").alias("errors")))
query("G04_progress_accumulation", "SELECT surface_key, CAST(rows_ingested + 2 * last_page AS BIGINT) AS rows_ingested FROM crawl_state")(
    lambda c: ingest.record_progress(c("crawl_state"), c("crawl_state").select("surface_key", "last_page", "is_exhausted", F.lit(None).cast("string").alias("last_error"), F.col("last_page").cast("long").alias("rows_ingested"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")), "seq").select("surface_key", "rows_ingested")
)
query("M06_record_progress", "SELECT surface_key, last_page + 1 AS last_page, CAST(rows_ingested + 25 AS BIGINT) AS rows_ingested FROM crawl_state")(
    lambda c: ingest.record_progress(c("crawl_state"), c("crawl_state").select("surface_key", (F.col("last_page") + 1).alias("last_page"), "is_exhausted", F.lit(25).cast("long").alias("rows_ingested"), F.lit(None).cast("string").alias("last_error"))).select("surface_key", "last_page", "rows_ingested")
)


def streamed(c: Corpus, windowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs a windowed aggregate over the events as a stream that ends, and returns its final table."""
    path, taken = f"{c.sf_dir}/events.parquet", scratch_path(c.spark, "windows")
    frame = c.spark.readStream.schema(c("events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{path}*")
    last = [f"{taken}/batch=0"]

    def write(batch: DataFrame, number: int) -> None:
        last[0] = f"{taken}/batch={number}"
        batch.write.mode("overwrite").parquet(last[0])

    feeds.run_available(windowed(feeds.with_event_time(frame)), f"{taken}-mark", write, "complete")
    return c.spark.read.parquet(last[0])


query("G01_stream_tumbling_windows", "SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda c: streamed(c, feeds.tumbling).select(F.col("w.start").alias("start"), "event_type", "n", "total"))
query("G01_batch_sliding_windows", "SELECT CAST(d AS VARCHAR) AS start, event_type, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL '1' DAY]) AS d, event_type FROM events) x GROUP BY 1, 2")(
    lambda c: feeds.sliding(c("events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("w.start").alias("start"), "event_type", "n")
)
query("G01_session_windows", "SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6' HOUR THEN 0 ELSE 1 END AS new FROM events) y) x GROUP BY user_id, s")(
    lambda c: feeds.sessions(c("events").withColumn("ts", F.col("ts").cast("timestamp"))).select("user_id", F.col("w.start").alias("start"), "n")
)

# --- mutations


def batch(c: Corpus) -> DataFrame:
    """An update of some stories (some with a new summary, some that are tombstoned), and some new ones."""
    old = c.embedded.filter("story_id % 10 = 0").withColumn("summary", F.when(F.col("story_id") % 20 == 0, F.concat("summary", F.lit("!"))).otherwise(F.col("summary")))
    new = c.embedded.filter("story_id % 50 = 1").withColumn("story_id", F.col("story_id") + 1_000_000)
    rows = old.unionByName(new).withColumn("favorite_count", F.col("favorite_count") + 1).withColumn("author_id", F.lit(-1).cast("long"))
    return rows.drop("first_seen_at", "last_seen_at", "deleted_at", "summary_embedding")


def upserted(c: Corpus) -> DataFrame:
    return ingest.upsert_stories(c.embedded, batch(c))


UPSERT = f"""SELECT story_id, favorite_count + CASE WHEN story_id % 10 = 0 THEN 1 ELSE 0 END AS favorite_count, author_id, CAST(CASE WHEN story_id % 10 = 0 THEN {TS} ELSE last_seen_at END AS VARCHAR) AS last_seen_at,
CASE WHEN story_id % 10 = 0 THEN NULL ELSE CAST(deleted_at AS VARCHAR) END AS deleted_at FROM stories_base
UNION ALL SELECT story_id + 1000000, favorite_count + 1, -1, CAST({TS} AS VARCHAR), NULL FROM stories_base WHERE story_id % 50 = 1"""
query("M01_story_upsert", UPSERT)(lambda c: upserted(c).select("story_id", "favorite_count", "author_id", "last_seen_at", "deleted_at"))


def kept_table(c: Corpus, rows: DataFrame, key: str = "story_id", counted: bool = False) -> versions.VersionedTable:
    """A versioned table of its own with these rows, a bucket for about a million of them."""
    views = versions.story_counts(c("story_fandoms"), c("fandoms")) if counted else None
    table = versions.VersionedTable(c.spark, scratch_path(c.spark, "table"), key, min(4096, max(8, rows.count() // 1_000_000)), views)
    table.create(rows)
    return table


@query("S13_upsert_sink", UPSERT)
def _(c: Corpus) -> DataFrame:
    table = kept_table(c, c.embedded)
    table.upsert(batch(c), ingest.upsert_stories)
    return table.read().select("story_id", "favorite_count", "author_id", "last_seen_at", "deleted_at")


def changed_three_times(c: Corpus) -> versions.VersionedTable:
    """An update with new stories, tombstones by staleness, and stories that are seen again: three commits."""
    table = kept_table(c, c.embedded, counted=True)
    table.upsert(batch(c), ingest.upsert_stories)
    table.upsert(table.read().filter(ingest.stale()).select("story_id"), lambda old, _: ingest.mark_stale(old)[0])
    again = c.embedded.filter("story_id % 7 = 0").drop("first_seen_at", "last_seen_at", "deleted_at", "summary_embedding")
    table.upsert(again, ingest.upsert_stories)
    return table


CHANGED = f"""changed AS (SELECT story_id, author_id, genres, characters, ships, language, rating, status, is_crossover, word_count, published_at, updated_at FROM stories_base
WHERE story_id % 7 = 0 OR story_id % 10 = 0 OR (deleted_at IS NULL AND last_seen_at >= {TS} - INTERVAL '180' DAY)
UNION ALL SELECT story_id + 1000000, -1, genres, characters, ships, language, rating, status, is_crossover, word_count, published_at, updated_at FROM stories_base WHERE story_id % 50 = 1)"""
query("S15_kept_facets", f"WITH {CHANGED} {FACETS.replace('live', 'changed')}")(lambda c: versions.kept_facets(changed_three_times(c)))


@query("G09_concurrent_writers", "SELECT story_id, favorite_count + CASE story_id % 10 WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS favorite_count FROM stories_base")
def _(c: Corpus) -> DataFrame:
    """Two writers at once on the same buckets: the one whose number is taken starts anew, and both changes stay."""
    table = kept_table(c, c.stories.withColumn("summary_embedding", F.lit(None).cast("array<float>")))

    def write(rest: int, more: int) -> None:
        rows = c.stories.filter(F.col("story_id") % 10 == rest).withColumn("favorite_count", F.col("favorite_count") + more)
        table.upsert(rows.drop("first_seen_at", "last_seen_at", "deleted_at"), ingest.upsert_stories)

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(write, (0, 5), (1, 2)))
    return table.read().select("story_id", "favorite_count")


@query("G01_exactly_once_feed", "SELECT concat('browse:book/c', CAST(o_custkey AS VARCHAR)) AS surface_key, CAST(25 * count(*) AS BIGINT) AS rows_ingested FROM orders GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    """A feed of progress rows, whose counts add up, in micro-batches; the whole stream is then replayed."""
    rows = c("orders").select(
        F.format_string("browse:book/c%d", "o_custkey").alias("surface_key"), (F.col("o_orderkey") % 100).cast("int").alias("last_page"), F.lit(False).alias("is_exhausted"), F.lit(25).cast("long").alias("rows_ingested"), F.lit(None).cast("string").alias("last_error"), F.col("o_orderkey").alias("seq")
    )
    feed, table = scratch_path(c.spark, "feed"), kept_table(c, rows.drop("seq").limit(0), "surface_key")
    rows.repartition(6).write.parquet(feed)
    for attempt in ("first", "replayed"):
        stream = feeds.file_stream(c.spark, feed, rows.schema, files_per_batch=2)
        feeds.ingest_once(stream, f"{feed}-{attempt}", table, "walk", lambda old, new: ingest.record_progress(old, new, "seq"))
    return table.read().select("surface_key", "rows_ingested")


@query("G07_embedding_worker", "SELECT story_id, 64 AS dims, CAST(1 AS BIGINT) AS times FROM stories WHERE deleted_at IS NULL AND summary_embedding IS NULL")
def _(c: Corpus) -> DataFrame:
    """Two workers at once; every story that lacked a vector is embedded, and by one of them."""
    table = kept_table(c, c.embedded)
    with ThreadPoolExecutor(2) as pool:
        folders = list(pool.map(lambda name: versions.embed_claimed(table, name, lambda rows: vectors.embed_missing(rows, dims=64), time.time), ("a", "b")))
    told = [c.spark.read.schema("story_id long").parquet(p) for own in folders for p in own]
    told = reduce(DataFrame.unionByName, told) if told else c.spark.createDataFrame([], "story_id long")
    times = told.groupBy("story_id").agg(F.count("*").alias("times"))
    return table.read().join(times, "story_id").select("story_id", F.size("summary_embedding").alias("dims"), "times")


query("M02_embedding_invalidation", "SELECT story_id FROM stories WHERE summary_embedding IS NOT NULL AND story_id % 20 <> 0")(lambda c: upserted(c).filter(F.col("summary_embedding").isNotNull()).select("story_id"))
query("M04_bridge_insert", "SELECT story_id, fandom_id FROM story_fandoms UNION SELECT story_id, 7 FROM story_fandoms WHERE story_id % 9 = 0")(
    lambda c: ingest.add_bridge(c("story_fandoms"), c("story_fandoms").filter("story_id % 9 = 0").select("story_id", F.lit(7).alias("fandom_id"))).select("story_id", "fandom_id")
)
query("M05_mark_stale", f"SELECT story_id, CAST(CASE WHEN deleted_at IS NULL AND last_seen_at < {TS} - INTERVAL '180' DAY THEN {TS} ELSE deleted_at END AS VARCHAR) AS deleted_at FROM stories_base")(lambda c: ingest.mark_stale(c.stories)[0].select("story_id", "deleted_at"))
query("G06_stale_affected", f"SELECT count(*) AS affected FROM stories_base WHERE deleted_at IS NULL AND last_seen_at < {TS} - INTERVAL '180' DAY")(lambda c: ingest.mark_stale(c.stories)[1])
query("M07_pair_upsert", "SELECT fandom_id_a, fandom_id_b FROM pairs UNION SELECT DISTINCT l_suppkey % 10, 200 + l_partkey % 10 FROM lineitem")(
    lambda c: ingest.add_pairs(c("pairs"), c("lineitem").select((F.col("l_suppkey") % 10).cast("int").alias("fandom_id_a"), (200 + F.col("l_partkey") % 10).cast("int").alias("fandom_id_b")), c("fandoms")).select(F.col("fandom_id_a").cast("long"), F.col("fandom_id_b").cast("long"))
)
query("M08_embedding_write_back", "SELECT story_id, len(summary_embedding)::INT AS dims FROM (SELECT story_id, coalesce(summary_embedding, CASE WHEN deleted_at IS NULL THEN (SELECT embedding FROM embeddings LIMIT 1) END) AS summary_embedding FROM stories) x WHERE summary_embedding IS NOT NULL")(
    lambda c: ingest.write_back(c.embedded, vectors.embed_missing(c.embedded, dims=64)).filter("summary_embedding IS NOT NULL").select("story_id", F.size("summary_embedding").alias("dims"))
)
query("Q04_crawl_state_lookup", "SELECT surface_key, last_page, is_exhausted FROM crawl_state WHERE surface_key = 'browse:book/Fandom-4'")(lambda c: c("crawl_state").filter("surface_key = 'browse:book/Fandom-4'").select("surface_key", "last_page", "is_exhausted"))


@query(
    "M03_fandom_upsert",
    "SELECT id, CASE WHEN section_slug = 'book' THEN concat(name, ' (new)') ELSE name END AS name, category_id, story_count FROM fandoms UNION ALL "
    "SELECT (SELECT max(id) FROM fandoms) + CAST(row_number() OVER (ORDER BY name) AS INT), concat('New ', name), 900 + id, 1 FROM fandoms WHERE section_slug = 'anime'",
)
def _(c: Corpus) -> DataFrame:
    f = c("fandoms")
    cut = f.withColumn("category_id", F.when(F.col("section_slug").isNull() | (F.col("section_slug") != "book"), F.col("category_id")))
    renamed = f.filter("section_slug = 'book'").withColumn("name", F.concat("name", F.lit(" (new)")))
    fresh = f.filter("section_slug = 'anime'").select(F.concat(F.lit("New "), "name").alias("name"), F.lit("tv").alias("section_slug"), F.concat(F.lit("New-"), "fandom_slug").alias("fandom_slug"), (F.col("id") + 900).alias("category_id"), F.lit(1).alias("story_count"))
    return ingest.upsert_fandoms(cut, renamed.drop("id").unionByName(fresh)).select("id", "name", "category_id", "story_count")


# --- named queries

STATS = f"SELECT count(*) AS stories, count(DISTINCT author_id) AS authors, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE {ABANDONED}) AS abandoned, count(*) FILTER (WHERE len(ships) > 0) AS with_ships, count(*) FILTER (WHERE is_crossover) AS crossovers, CAST(coalesce(sum(word_count), 0) AS BIGINT) AS total_words, CAST(CAST(min(published_at) AS DATE) AS VARCHAR) AS earliest, CAST(CAST(max(published_at) AS DATE) AS VARCHAR) AS latest, '{AS_OF}' AS computed_at FROM live"
query("N03_stats", STATS)(lambda c: analytics.stats(c.stories))
query("G08_kept_statistics", f"WITH {CHANGED} {STATS.replace('live', 'changed')}")(lambda c: versions.kept_stats(changed_three_times(c)))
query("N04_abandonment_report", f"SELECT story_id, title, author_name, word_count, chapter_count, CAST(CAST(updated_at AS DATE) AS VARCHAR) AS last_touched, CAST(date_part('year', age({TS}, updated_at)) AS INT) AS years_stale, favorite_count FROM live WHERE {ABANDONED} AND word_count > 20000 ORDER BY favorite_count DESC, story_id DESC LIMIT 20")(
    lambda c: analytics.abandonment_report(c.stories)
)
query("N05_length_adjusted", f"SELECT story_id, title, author_name, word_count, favorite_count, {RATIO} AS favorites_per_1k_words FROM live WHERE word_count BETWEEN 1000 AND 20000 AND favorite_count > 20 ORDER BY 6 DESC, story_id DESC LIMIT 20")(lambda c: analytics.length_adjusted(c.stories))
query("N06_ship_leaderboard", f"{LEADERS} ORDER BY stories DESC, ship LIMIT 20")(lambda c: analytics.ship_leaderboard(c.stories))
N07 = "SELECT story_id, title, author_name, array_to_string(genres, '|') AS genres, array_to_string(characters, '|') AS characters, word_count, favorite_count FROM live WHERE status = 'complete' AND word_count > 10000 AND NOT list_has_any(genres, ['Romance']) AND NOT list_has_any(characters, ['OC']) ORDER BY favorite_count DESC, story_id DESC LIMIT 20"
query("N07_exclusions", N07)(lambda c: analytics.exclusions(c.stories))
query("N07_exclusions_bitmaps", N07)(
    lambda c: analytics.exclusions(bitmaps.narrowed(c.stories, bitmaps.write_index(c.stories, scratch_path(c.spark, "bitmaps")), SearchFilters(excluded_genres=["Romance"], excluded_characters=["OC"])))
)
query("N08_corpus_shape", "SELECT count(*) AS stories, count(DISTINCT author_id) AS authors, count(*) FILTER (WHERE status = 'complete') AS complete, count(*) FILTER (WHERE len(ships) > 0) AS with_ships, count(*) FILTER (WHERE is_crossover) AS crossovers, count(DISTINCT language) AS languages, CAST(sum(strlen(summary) + strlen(title)) AS BIGINT) AS text_bytes, CAST(CAST(min(published_at) AS DATE) AS VARCHAR) AS earliest, CAST(CAST(max(published_at) AS DATE) AS VARCHAR) AS latest FROM live")(
    lambda c: analytics.corpus_shape(c.stories)
)
query("N01_search_page", f"SELECT story_id, title, {RATIO} AS favorites_per_1k_words, {ABANDONED} AS is_abandoned FROM live WHERE rating IN ('K', 'T') AND NOT list_has_any(genres, ['Horror']) AND favorite_count >= 10 ORDER BY favorite_count DESC NULLS LAST, story_id DESC LIMIT 25 OFFSET 25")(
    lambda c: search.projected(search.search(c.stories, SearchFilters(ratings=["K", "T"], excluded_genres=["Horror"], min_favorites=10, sort="favorites", page=2)), AS_OF).select("story_id", "title", "favorites_per_1k_words", "is_abandoned")
)
query("N01_capped_total", "SELECT count(*) AS total FROM (SELECT 1 FROM live WHERE rating IN ('K', 'T') LIMIT 10000) x")(lambda c: search.capped_count(filtered(c.stories, SearchFilters(ratings=["K", "T"]))))


@query(
    "N10_backfill_estimate",
    "SELECT stories, round(stories / 24.5 + fandoms + (18 + crossover_fandoms) + pairs * 2.0, 3) AS requests, round((stories / 24.5 + fandoms + (18 + crossover_fandoms) + pairs * 2.0) * 5.83, 3) AS seconds, "
    "round((stories / 24.5 + 0.5 * fandoms + (18 + crossover_fandoms) + pairs * 1.0) * 5.83, 3) AS shortcut_seconds, CAST(stories * 3481 AS BIGINT) AS raw_bytes, round(stories * 3481 * 1.4, 1) AS indexed_bytes, stories > 14584841 AS implausible "
    "FROM (SELECT CAST((SELECT count(*) FROM live) AS DOUBLE) AS stories, (SELECT count(*) FROM fandoms) AS fandoms, (SELECT count(*) FROM fandoms WHERE id % 2 = 0) AS crossover_fandoms, (SELECT count(*) FROM pairs) AS pairs) x",
)
def _(c: Corpus) -> DataFrame:
    totals = analytics.live(c.stories).agg(F.count("*").cast("double").alias("stories")).crossJoin(c("fandoms").agg(F.count("*").alias("fandoms"), F.count_if(F.col("id") % 2 == 0).alias("crossover_fandoms"))).crossJoin(c("pairs").agg(F.count("*").alias("pairs")))
    return analytics.backfill_estimate(totals)


@query("N11_footprint", "SELECT round(sum(b) / 1000.0 * 8770708, 0) AS projected, round(sum(b) / 1000.0 * 8770708 - 0.5 * sum(CASE WHEN v THEN b ELSE 0 END) / 1000.0 * 8770708, 0) AS half_precision FROM (SELECT CAST(p_size * 100000 AS DOUBLE) AS b, p_size % 2 = 0 AS v FROM part WHERE p_size * 100000 >= 100000) x")
def _(c: Corpus) -> DataFrame:
    objects = c("part").select((F.col("p_size") * 100000).cast("double").alias("bytes"), (F.col("p_size") % 2 == 0).alias("is_vector"))
    return analytics.footprint(objects, 1000).select("projected", "half_precision")


@query("N14_probe_report", f"SELECT story_id, concat(CAST(story_id AS VARCHAR), ': ', author_name, ' [', coalesce(rating, ''), '/', language, '] ', CASE WHEN len(genres) > 0 THEN array_to_string(genres, '/') ELSE 'no genre' END) AS line {RATED} ORDER BY story_id LIMIT 5")
def _(c: Corpus) -> DataFrame:
    line = F.concat(F.col("story_id").cast("string"), F.lit(": "), "author_name", F.lit(" ["), "rating", F.lit("/"), "language", F.lit("] "), F.when(F.size("genres") > 0, F.array_join("genres", "/")).otherwise("no genre"))
    return parsed(c).select("story_id", line.alias("line")).orderBy("story_id").limit(5)


@query("S14_json_result", None)
def _(c: Corpus) -> DataFrame:
    return search.projected(search.search(c.stories, SearchFilters(sort="favorites")), AS_OF).select("story_id", F.to_json(F.struct("title", "rating", "genres", "ships", "url")).alias("json"))


@query("W_relational_semi_join", "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1")
def _(c: Corpus) -> DataFrame:
    big = c("lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return c("orders").join(big, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("orders"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda f: lambda spark, sf_dir: plain(f(Corpus(spark, sf_dir))))(f) for name, (f, _) in REGISTRY.items()}
ORACLE_SQL = {name: corpus.oracle(sql) for name, (_, sql) in REGISTRY.items() if sql}
__all__ = ["ORACLE_SQL", "QUERIES", "Corpus", "json", "overlaps"]
