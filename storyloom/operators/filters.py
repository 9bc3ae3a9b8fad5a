"""Search filters as one predicate. Lists and texts that are empty filter nothing; a bound of 0 is a bound."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as fulltext
from storyloom.plans.corpus import AS_OF
from storyloom.schema import ABANDONED_YEARS, DEFAULT_SORT, PAGE_SIZE, STATUSES


@dataclass(frozen=True)
class SearchFilters:
    query: str = ""
    fandoms: Sequence[str] = ()
    ratings: Sequence[str] = ()
    languages: Sequence[str] = ()
    genres: Sequence[str] = ()
    excluded_genres: Sequence[str] = ()
    characters: Sequence[str] = ()
    excluded_characters: Sequence[str] = ()
    ship: Sequence[str] = ()
    status: str | None = None
    crossover: bool | None = None
    exclude_abandoned: bool = False
    only_abandoned: bool = False
    min_words: int | None = None
    max_words: int | None = None
    min_favorites: int | None = None
    min_chapters: int | None = None
    sort: str = DEFAULT_SORT
    page: int = 1
    page_size: int = PAGE_SIZE
    vector: Sequence[float] | None = field(default=None, repr=False)
    as_of: str = AS_OF
    stemmed: bool = False

    def __post_init__(self):
        if self.status is not None and self.status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}")


def is_abandoned(as_of: str = AS_OF) -> Column:
    """In progress and not updated for two calendar years; unknown (null) where the update is."""
    return (F.col("status") == "in_progress") & (F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL '{ABANDONED_YEARS}' YEAR"))


def is_abandoned_by_days(as_of: str = AS_OF) -> Column:
    """The record's own form: more than 730 whole days of 24 hours."""
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("updated_at")
    return (F.col("status") == "in_progress") & F.coalesce(F.floor(seconds / 86400) > 730, F.lit(False))


def overlaps(column: str, wanted: Sequence[str]) -> Column:
    return F.coalesce(F.arrays_overlap(column, F.array(*map(F.lit, wanted))), F.lit(False))


def in_one_group(column: str, members: Sequence[str]) -> Column:
    """All members inside one bracket group."""
    own = list(dict.fromkeys(members))
    array = F.array(*map(F.lit, own))
    return F.coalesce(F.exists(column, lambda g: F.size(F.array_intersect(g, array)) == len(own)), F.lit(False))


def predicate(f: SearchFilters) -> Column:
    """All filters but the fandom one, which is a join; three-valued logic is kept as SQL has it."""
    out = [F.col("deleted_at").isNull()]
    if f.vector is not None:
        out.append(F.col("summary_embedding").isNotNull())
    if f.query:
        out.append(fulltext.matches(f.query, f.stemmed))
    if f.ratings:
        out.append(F.col("rating").isin(*f.ratings))
    if f.languages:
        out.append(F.col("language").isin(*f.languages))
    for column, wanted, excluded in (("genres", f.genres, f.excluded_genres), ("characters", f.characters, f.excluded_characters)):
        if wanted:
            out.append(overlaps(column, wanted))
        if excluded:
            out.append(~overlaps(column, excluded))
    if f.ship:
        out.append(in_one_group("ships", f.ship))
    if f.status is not None:
        out.append(F.col("status") == f.status)
    if f.crossover is not None:
        out.append(F.col("is_crossover") == f.crossover)
    if f.exclude_abandoned:
        out.append(~is_abandoned(f.as_of))
    if f.only_abandoned:
        out.append(is_abandoned(f.as_of))
    if f.min_words is not None:
        out.append(F.col("word_count") >= f.min_words)
    if f.max_words is not None:
        out.append(F.col("word_count") <= f.max_words)
    if f.min_favorites is not None:
        out.append(F.col("favorite_count") >= f.min_favorites)
    if f.min_chapters is not None:
        out.append(F.col("chapter_count") >= f.min_chapters)
    return reduce(lambda a, b: a & b, out)


def filtered(stories: DataFrame, f: SearchFilters, story_fandoms: DataFrame | None = None, fandoms: DataFrame | None = None) -> DataFrame:
    """The stories that pass. Cheap column filters stand before the token columns, so they reach the scan."""
    rows = fulltext.with_document(stories.filter(F.col("deleted_at").isNull()), f.stemmed) if f.query else stories
    rows = rows.filter(predicate(f))
    if f.fandoms:
        if story_fandoms is None or fandoms is None:
            raise ValueError("a fandom filter needs the bridge and the fandoms")
        named = story_fandoms.join(fandoms.filter(F.col("name").isin(*f.fandoms)).select(F.col("id").alias("fandom_id")), "fandom_id", "left_semi")
        rows = rows.join(named, "story_id", "left_semi")
    return rows
