"""The data model: types, fixed vocabularies, and the columns that follow from others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The site's genre vocabulary and archive sections.
GENRES = (
    "General", "Romance", "Humor", "Drama", "Poetry", "Adventure", "Mystery", "Horror", "Parody", "Angst", "Supernatural",
    "Suspense", "Sci-Fi", "Fantasy", "Spiritual", "Tragedy", "Western", "Crime", "Family", "Hurt/Comfort", "Friendship",
)
SECTIONS = ("anime", "book", "cartoon", "comic", "game", "misc", "movie", "play", "tv")
STATUSES = ("in_progress", "complete")
RATINGS = ("K", "K+", "T", "M")

#: Fixed values of search and ingestion.
MAX_PAGE_SIZE, PAGE_SIZE, DEFAULT_SORT = 100, 25, "updated"
COUNT_CEILING = 10_000
ABANDONED_YEARS = 2
SHORTLIST_FACTOR, SHORTLIST_LEAST = 10, 500
EMBEDDING_DIMS, EMBEDDING_CHARS = 768, 2000
STALE_DAYS = 180
REFRESH_PAGES = 20
QUEUE_BATCH, EMBED_BATCH = 25, 32
FACET_LIMITS = {"fandoms": 200, "genres": 50, "characters": 300, "languages": 50, "ratings": 10, "ships": 100}

FANDOM = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("section_slug", T.StringType()),
        T.StructField("fandom_slug", T.StringType()),
        T.StructField("category_id", T.IntegerType()),
        T.StructField("story_count", T.LongType()),
    ]
)
STRINGS = T.ArrayType(T.StringType(), False)
#: What a listing row yields.
STORY = T.StructType(
    [
        T.StructField("story_id", T.LongType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("author_id", T.LongType()),
        T.StructField("author_name", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("is_crossover", T.BooleanType()),
        T.StructField("rating", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("genres", STRINGS),
        T.StructField("characters", STRINGS),
        T.StructField("ships", T.ArrayType(STRINGS, False)),
        T.StructField("chapter_count", T.IntegerType()),
        T.StructField("word_count", T.IntegerType()),
        T.StructField("review_count", T.IntegerType()),
        T.StructField("favorite_count", T.IntegerType()),
        T.StructField("follow_count", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("published_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("cover_image_id", T.LongType()),
    ]
)
#: What the stories table adds to a record.
STORED = T.StructType(
    [
        *STORY.fields,
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_seen_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
        T.StructField("summary_embedding", T.ArrayType(T.FloatType())),
    ]
)
CRAWL_STATE = "surface_key string, last_page int, is_exhausted boolean, rows_ingested long, last_error string, updated_at timestamp"
PAIRS = "fandom_id_a int, fandom_id_b int, slug_a string, slug_b string"


def favorites_per_1k(favorites: Column, words: Column) -> Column:
    """Favorites per thousand words to four places, half away from zero; null without words."""
    exact = favorites.cast("decimal(20,0)") * 1000 / words
    return F.when(words > 0, F.round(exact, 4))


def sign_bits(vector: Column) -> Column:
    """The signs of a vector, 64 to a long: bit i of a long is set where its i-th number is positive."""
    words = F.transform(
        F.sequence(F.lit(0), (F.size(vector) - 1).cast("int"), F.lit(64)),
        lambda at: F.aggregate(
            F.transform(F.slice(vector, at + 1, F.lit(64)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
            F.lit(0).cast("long"),
            lambda acc, bit: acc.bitwiseOR(bit),
        ),
    )
    return F.when(F.size(vector) > 0, words)


def with_derived(stories: DataFrame) -> DataFrame:
    """Adds the generated columns; they are computed once, on write."""
    return stories.withColumns({"favorites_per_1k_words": favorites_per_1k(F.col("favorite_count"), F.col("word_count")), "summary_embedding_bits": sign_bits(F.col("summary_embedding"))})
