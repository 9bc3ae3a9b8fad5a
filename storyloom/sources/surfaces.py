"""The crawl surfaces as URL expressions, and what a fetched page is.

Nothing here fetches. A live source must keep DELAY_SECONDS between requests, back off 2^n seconds on server errors, obey
Retry-After, and stop for good at a 403."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.schema import SECTIONS

#: The site and its codes.
ORIGIN = "https://www.fanfiction.net"
SORT = {"update": 1, "publish": 2, "reviews": 3, "favorites": 4, "follows": 5}
STATUS = {"all": 0, "in_progress": 1, "complete": 2}
ALL_RATINGS = 10
ROWS_PER_PAGE = {"archive": 25, "firehose": 100, "search": 50}
DELAY_SECONDS, JITTER_SECONDS, TRIES, TIMEOUT_SECONDS, RETRY_AFTER_SECONDS = 5.0, 0.2, 4, 30, 60
APPLICATION_ERROR = "FanFiction.Net Error Type"
NOT_FOUND = "The page you are looking for does not exist"


def firehose_url() -> str:
    return f"{ORIGIN}/j/0/0/0/"


def section_directory_url(section: str) -> str:
    if section not in SECTIONS:
        raise ValueError(f"unknown section {section!r}; one of {SECTIONS} is expected")
    return f"{ORIGIN}/{section}/"


def section_directories(spark: SparkSession, fandoms: DataFrame | None = None) -> DataFrame:
    """(section, url, crossover_url) of all sections; with known_fandoms, how many of the given ones each has, so that a
    walk can start with the sections that it knows least of."""
    rows = spark.range(1).select(F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    rows = rows.select("section", F.concat(F.lit(f"{ORIGIN}/"), "section", F.lit("/")).alias("url"), F.concat(F.lit(f"{ORIGIN}/crossovers/"), "section", F.lit("/")).alias("crossover_url"))
    if fandoms is None:
        return rows
    known = fandoms.groupBy(F.col("section_slug").alias("section")).agg(F.count("*").alias("known_fandoms"))
    return rows.join(known, "section", "left").withColumn("known_fandoms", F.coalesce("known_fandoms", F.lit(0).cast("long")))


def browse_url(section: Column, slug: Column, page: Column, sort: str = "publish", status: str = "all", language: int = 0, rating: int = ALL_RATINGS) -> Column:
    tail = (f"&s={STATUS[status]}" if status != "all" else "") + (f"&lan={language}" if language else "")
    return F.concat(F.lit(f"{ORIGIN}/"), section, F.lit("/"), slug, F.lit(f"/?srt={SORT[sort]}&r={rating}&p="), page.cast("string"), F.lit(tail))


def crossover_archive_url(slug_a: Column, id_a: Column, slug_b: Column, id_b: Column, page: Column, sort: str = "publish") -> Column:
    """The pair stands in ascending order of ids, whichever way it is given."""
    swap = id_a > id_b
    first, second = F.when(swap, slug_b).otherwise(slug_a), F.when(swap, slug_a).otherwise(slug_b)
    return F.concat(
        F.lit(f"{ORIGIN}/"), first, F.lit("-and-"), second, F.lit("-Crossovers/"), F.least(id_a, id_b).cast("string"), F.lit("/"), F.greatest(id_a, id_b).cast("string"), F.lit(f"/?srt={SORT[sort]}&r={ALL_RATINGS}&p="), page.cast("string")
    )


def partners_url(slug: Column, category_id: Column) -> Column:
    return F.concat(F.lit(f"{ORIGIN}/crossovers/"), slug, F.lit("/"), category_id.cast("string"), F.lit("/"))


def search_url(keywords: Column, page: int = 1, category_id: int = 0) -> Column:
    tail = f"&ready=1&type=story&ppage={page}" + (f"&categoryid={category_id}" if category_id else "")
    return F.concat(F.lit(f"{ORIGIN}/search/?keywords="), F.url_encode(keywords), F.lit(tail))


def story_url(story_id: Column, chapter: Column | None = None) -> Column:
    return F.concat(F.lit(f"{ORIGIN}/s/"), story_id.cast("string"), F.lit("/"), F.lit("1") if chapter is None else chapter.cast("string"), F.lit("/"))


def classified(status: Column, body: Column) -> Column:
    """ok, blocked, throttled, server_error, not_found or app_error; the last two come with status 200."""
    return (
        F.when(status == 403, "blocked").when(status == 429, "throttled").when(status >= 500, "server_error").when(F.contains(body, F.lit(NOT_FOUND)), "not_found")
        .when(F.contains(body, F.lit(APPLICATION_ERROR)), "app_error").otherwise("ok")
    )


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of a folder of pages, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def default_name(slug: Column) -> Column:
    return F.replace(slug, F.lit("-"), F.lit(" "))


def placeholder_name(category_id: Column) -> Column:
    return F.concat(F.lit("FFN category "), category_id.cast("string"))
