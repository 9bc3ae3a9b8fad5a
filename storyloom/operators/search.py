"""A search page, its capped total, and the two-phase vector search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as fulltext
from storyloom.functions import vectors
from storyloom.operators.filters import SearchFilters, filtered, is_abandoned, predicate
from storyloom.schema import COUNT_CEILING, DEFAULT_SORT, MAX_PAGE_SIZE, SHORTLIST_FACTOR, SHORTLIST_LEAST, favorites_per_1k, sign_bits

SORTS = {
    "updated": "updated_at", "published": "published_at", "favorites": "favorite_count", "reviews": "review_count", "follows": "follow_count",
    "words": "word_count", "favorites_per_1k": "favorites_per_1k_words",
}
RESULT = (
    "story_id", "title", "author_id", "author_name", "summary", "is_crossover", "rating", "language", "genres", "characters", "ships", "chapter_count",
    "word_count", "review_count", "favorite_count", "follow_count", "status", "published_at", "updated_at", "favorites_per_1k_words",
)
STORY_URL = "https://www.fanfiction.net/s/%d/1/"


def order_of(f: SearchFilters) -> list[Column]:
    """A vector's distance first, then the text rank, then a column; ties by descending id."""
    last = F.col("story_id").desc()
    if f.vector is not None and f.sort in ("semantic", "relevance"):
        return [F.col("distance").asc(), last]
    if f.sort == "relevance" and f.query:
        return [F.col("rank").desc(), last]
    return [F.col(SORTS.get(f.sort, SORTS[DEFAULT_SORT])).desc_nulls_last(), last]


def window_of(f: SearchFilters) -> tuple[int, int]:
    """(offset, limit) of the page."""
    size = min(max(1, f.page_size), MAX_PAGE_SIZE)
    return (max(f.page, 1) - 1) * size, size


def with_ratio(stories: DataFrame) -> DataFrame:
    if "favorites_per_1k_words" in stories.columns:
        return stories
    return stories.withColumn("favorites_per_1k_words", favorites_per_1k(F.col("favorite_count"), F.col("word_count")))


def shortlist(rows: DataFrame, f: SearchFilters) -> DataFrame:
    """Phase one: the nearest by sign bits among all rows that pass the filters; top-k per partition, then merged."""
    size = max(SHORTLIST_FACTOR * window_of(f)[1], SHORTLIST_LEAST)
    q = vectors.rounded(f.vector)
    bits = F.col("summary_embedding_bits") if "summary_embedding_bits" in rows.columns else sign_bits(F.col("summary_embedding"))
    near = rows.withColumn("hamming", vectors.hamming(bits, vectors.query_bits(q)))
    return near.orderBy(F.col("hamming").asc(), F.col("story_id").desc()).limit(size)


def search(stories: DataFrame, f: SearchFilters, story_fandoms: DataFrame | None = None, fandoms: DataFrame | None = None) -> DataFrame:
    """The page of results in order; without a window count, so the plan is a top-k. With a vector and its order,
    the shortlist is reranked by exact cosine distance (rounded to 12 places, so that ties are the same everywhere)."""
    rows = with_ratio(filtered(stories, f, story_fandoms, fandoms))
    if f.vector is not None and f.sort in ("semantic", "relevance"):
        rows = shortlist(rows, f).withColumn("distance", F.round(vectors.cosine_distance(F.col("summary_embedding"), vectors.rounded(f.vector)), 12))
    elif f.sort == "relevance" and f.query:
        rows = rows.withColumn("rank", fulltext.rank(f.query, f.stemmed))
    offset, size = window_of(f)
    return rows.orderBy(*order_of(f)).offset(offset).limit(size)


def projected(rows: DataFrame, as_of: str) -> DataFrame:
    """The result columns, whether the story is abandoned, and its url."""
    return rows.select(*RESULT, is_abandoned(as_of).alias("is_abandoned"), F.format_string(STORY_URL, "story_id").alias("url"))


def with_fandoms(rows: DataFrame, story_fandoms: DataFrame, fandoms: DataFrame) -> DataFrame:
    """Adds the sorted names of each story's fandoms, an empty array without any. Rows are few (a page), so the bridge
    is cut down to them before it meets the names."""
    named = story_fandoms.join(rows.select("story_id"), "story_id", "left_semi").join(fandoms.select(F.col("id").alias("fandom_id"), "name"), "fandom_id")
    lists = named.groupBy("story_id").agg(F.array_sort(F.collect_list("name")).alias("fandoms"))
    return rows.join(lists, "story_id", "left").withColumn("fandoms", F.coalesce("fandoms", F.array().cast("array<string>")))


def capped_count(rows: DataFrame, most: int = COUNT_CEILING) -> DataFrame:
    """One row: total, at most `most`; partitions stop early."""
    return rows.select(F.lit(1).alias("one")).limit(most).agg(F.count("*").alias("total"))


def probes(stories: DataFrame, filters: dict[str, SearchFilters]) -> DataFrame:
    """(probe, stories): how many live stories each set of filters finds, all in one scan."""
    rows = fulltext.with_document(stories.filter(F.col("deleted_at").isNull())) if any(f.query for f in filters.values()) else stories
    counts = [F.struct(F.lit(name).alias("probe"), F.count_if(predicate(f)).alias("stories")) for name, f in filters.items()]
    return rows.agg(F.array(*counts).alias("all")).select(F.inline("all"))


def envelope(stories: DataFrame, f: SearchFilters, story_fandoms: DataFrame | None = None, fandoms: DataFrame | None = None) -> dict:
    """What the search endpoint answers: the page, the capped total and flags."""
    page = projected(search(stories, f, story_fandoms, fandoms), f.as_of)
    total = capped_count(filtered(stories, replace(f, page=1), story_fandoms, fandoms)).first().total
    return {"results": page, "total": total, "totalIsCapped": total >= COUNT_CEILING, "page": max(f.page, 1), "pageSize": window_of(f)[1], "semantic": f.vector is not None}
