"""Full text from a stored inverted table, so that a query reads its own words' rows and no text.

The table has a row per (term, story) with the term's places in title (a), author (b) and summary (c). It is written in
folders by a hash of the term and sorted by term: a query's words prune folders first, row groups then. Ranges of
(term, story_id) are dealt to the writing tasks, so a term that a third of all stories hold is split among several files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import text as fulltext
from storyloom.operators.filters import SearchFilters, filtered
from storyloom.operators.search import order_of, window_of, with_ratio

#: Folders of the stored table.
BUCKETS = 64
#: About so many words are dealt to postings at once; a story stays whole.
WORDS = 400_000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _posted(rows: pa.Table, story: np.ndarray) -> pa.RecordBatch:
    """The postings of these rows; `story` numbers their stories, in order."""
    terms, keys, places = [], [], []
    for part in fulltext.WEIGHTS:
        tokens = rows[f"doc_{part}"].combine_chunks()
        lengths = np.diff(tokens.offsets.to_numpy())
        terms.append(tokens.flatten())
        keys.append(np.repeat(story, lengths))
        places.append(np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    parts = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
    words = pa.concat_arrays(terms).dictionary_encode()
    # ordered by story, term, part and place
    key = (np.concatenate(keys) * max(1, len(words.dictionary)) + words.indices.to_numpy()) * len(terms) + parts
    place = np.concatenate(places)
    order = np.lexsort((place, key))
    key, place, part = key[order], place[order].astype(np.int32), parts[order]
    new = np.flatnonzero(np.diff(key // len(terms), prepend=-1))
    group = np.repeat(np.arange(len(new)), np.diff(new, append=len(key)))
    pair = key[new] // len(terms)
    ids = rows["story_id"].combine_chunks().take(pa.array(np.searchsorted(story, pair // max(1, len(words.dictionary)))))
    lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(group[part == k], minlength=len(new)))]).astype(np.int32), place[part == k]) for k in range(len(terms))]
    return pa.RecordBatch.from_arrays([ids, words.dictionary.take(pa.array(pair % max(1, len(words.dictionary)))), *lists], names=["story_id", "term", *fulltext.WEIGHTS])


def _stories_posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of stories; the last story of a batch may go on in the next."""
    held: pa.Table | None = None

    def posted(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        story = rows["story_id"].combine_chunks().dictionary_encode("encode").indices.to_numpy().astype(np.int64)
        words = np.cumsum(sum(np.diff(rows[f"doc_{k}"].combine_chunks().offsets.to_numpy()) for k in fulltext.WEIGHTS))
        starts = np.flatnonzero(np.diff(story, prepend=-1))
        stop = len(story) if last else int(starts[-1])
        held, at = rows.slice(stop), 0
        for end in [int(x) for x in starts[1:] if x < stop] + [stop]:
            if end > at and (end == stop or words[end - 1] - (words[at - 1] if at else 0) >= WORDS):
                yield _posted(rows.slice(at, end - at), story[at:end])
                at = end

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            yield from posted(pa.concat_tables([held, table]) if held is not None and held.num_rows else table, False)
    if held is not None and held.num_rows:
        yield from posted(held, True)


def postings(stories: DataFrame, stemmed: bool = False, dealt: Column | None = None) -> DataFrame:
    """(bucket, term, story_id, a, b, c): the places of each term of each live story, empty where a part lacks it. A null
    title, author or summary has no terms. Texts are dealt by story, or by `dealt`, a function of story_id; their words are
    not dealt again."""
    live = stories.filter(F.col("deleted_at").isNull()).select(F.col("story_id").cast("long").alias("story_id"), "title", "author_name", "summary")
    rows = fulltext.with_document(live.repartition(F.col("story_id") if dealt is None else dealt).sortWithinPartitions("story_id"), stemmed).select("story_id", *[f"doc_{k}" for k in fulltext.WEIGHTS])
    each = rows.mapInArrow(_stories_posted, "story_id long, term string, a array<int>, b array<int>, c array<int>")
    return each.select(bucket_of(F.col("term")).alias("bucket"), "term", "story_id", *fulltext.WEIGHTS)


def write_index(stories: DataFrame, path: str, stemmed: bool = False) -> DataFrame:
    """Writes the inverted table and returns it as read back."""
    rows = postings(stories, stemmed).repartitionByRange("bucket", "term", "story_id").sortWithinPartitions("bucket", "term", "story_id")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(path)
    return read_index(stories.sparkSession, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, story_id long, a array<int>, b array<int>, c array<int>, bucket int").parquet(path)


def _starts(words: tuple[str, ...], part: str, number: dict[str, int]) -> Column:
    """Where the phrase's words stand one after the other in a part."""

    def first(k: int, word: str) -> Column:
        return F.transform(F.coalesce(F.col(f"{part}{number[word]}"), F.array().cast("array<int>")), lambda place: place - k)

    return reduce(F.array_intersect, [first(k, w) for k, w in enumerate(words)])


def matching(index: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """(story_id, rank) of the stories that satisfy the query, as the scan of the texts finds and ranks them. A part of
    the query (between two `or`) that only negates has no rows to start from: ValueError; such queries need the scan."""
    groups = fulltext.parse_query(query, stemmed)
    if not answerable(query, stemmed):
        raise ValueError("a query that only negates cannot start from the inverted table")
    words = sorted({w for g in groups for t in g for w in t.words})
    number = {w: i for i, w in enumerate(words)}
    own = index.filter(F.col("bucket").isin(*[bucket_of(F.lit(w)) for w in words]) & F.col("term").isin(*words)) if words else index.filter(F.lit(False))
    places = [F.max(F.when(F.col("term") == w, F.col(k))).alias(f"{k}{i}") for w, i in number.items() for k in fulltext.WEIGHTS]
    rows = own.groupBy("story_id").agg(*(places or [F.count("*").alias("n")]))
    if not words:
        return rows.select("story_id", F.lit(0.0).alias("rank"))

    def holds(t: fulltext.Term) -> Column:
        found = reduce(lambda a, b: a | b, [F.size(_starts(t.words, k, number)) > 0 for k in fulltext.WEIGHTS])
        return ~found if t.negated else found

    passes = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, map(holds, g)) for g in groups])
    counted = sorted({w for g in groups for t in g if not t.negated for w in t.words})
    tf = [reduce(lambda a, b: a + b, [F.coalesce(F.size(F.col(f"{k}{number[w]}")), F.lit(0)) for w in counted]) * F.lit(v) for k, v in fulltext.WEIGHTS.items()]
    return rows.filter(passes).select("story_id", F.round(reduce(lambda a, b: a + b, tf), 6).alias("rank"))


def answerable(query: str, stemmed: bool = False) -> bool:
    """Whether every part of the query between two `or` has a word that must be there."""
    return all(any(not t.negated for t in g) for g in fulltext.parse_query(query, stemmed))


def search(stories: DataFrame, index: DataFrame, f: SearchFilters, story_fandoms: DataFrame | None = None, fandoms: DataFrame | None = None) -> DataFrame:
    """The page of a text search by the inverted table: its matches meet the stories that pass the other filters. Orders
    by the rank (relevance) or a column; a query with a vector belongs to the two-phase search. A query that only
    negates, or none, must go to the search over the texts."""
    if f.vector is not None or not f.query:
        raise ValueError("the inverted table answers text queries without a vector")
    rows = with_ratio(filtered(stories, replace(f, query=""), story_fandoms, fandoms)).join(matching(index, f.query, f.stemmed), "story_id")
    offset, size = window_of(f)
    return rows.orderBy(*order_of(f)).offset(offset).limit(size)
