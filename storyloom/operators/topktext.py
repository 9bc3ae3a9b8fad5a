"""The best page of a text search from postings in blocks with stored maximal scores, without ranking every match.

Stories are dealt to ranges of `span` ids. A block is one term's postings in one range and keeps the largest score that the
term has in a story of it. The sum of a query's block maxima bounds the rank of every story of a range, and a range that
lacks a word that must be there holds no match. Ranges are read in descending order of that bound, until the page's last
rank is above the bound of all ranges not read: those cannot enter the page. All postings of a range lie in one folder, so
what is read and shuffled are the chosen ranges alone. Bounds are compared strictly, so ties come out as in a scan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as fulltext
from storyloom.operators import textindex
from storyloom.operators.filters import SearchFilters, filtered
from storyloom.operators.search import order_of, window_of, with_ratio

#: Ids of a range.
SPAN = 4096
#: Folders of the postings, by a hash of the range.
SLOTS = 64
#: Files, at most, of a folder of blocks.
FILES = 8
#: Ranges that the first look reads; each further look reads GROWTH times as many, and beyond MOST all postings are read.
FIRST, GROWTH, MOST = 8, 4, 2048


@dataclass(frozen=True)
class BlockIndex:
    """postings: slot, range, term, story_id, a, b, c. blocks: bucket, term, range, best, stories."""

    postings: DataFrame
    blocks: DataFrame
    span: int
    stemmed: bool


def _range_of(story_id: Column, span: int) -> Column:
    return F.floor(story_id / span)


def _slot_of(number: Column) -> Column:
    return F.pmod(F.xxhash64(number.cast("long")), F.lit(SLOTS)).cast("int")


def write_index(stories: DataFrame, path: str, span: int = SPAN, stemmed: bool = False) -> BlockIndex:
    """Writes postings, in folders by range and sorted by (range, term), and their blocks, in folders by term."""
    rows = textindex.postings(stories, stemmed, _range_of(F.col("story_id"), span)).drop("bucket").withColumn("range", _range_of(F.col("story_id"), span))
    rows = rows.withColumn("slot", _slot_of(F.col("range")))
    # a range's texts lie in one task, so its postings do; a deal by ranges of values would make them twice, once to sample
    rows.sortWithinPartitions("slot", "range", "term", "story_id").write.partitionBy("slot").parquet(f"{path}/postings")
    spark = stories.sparkSession
    postings = spark.read.schema("term string, story_id long, a array<int>, b array<int>, c array<int>, range long, slot int").parquet(f"{path}/postings")
    score = reduce(Column.__add__, [F.size(k) * F.lit(v) for k, v in fulltext.WEIGHTS.items()])
    blocks = postings.groupBy("term", "range").agg(F.max(score).alias("best"), F.count("*").alias("stories"))
    blocks = blocks.withColumn("bucket", textindex.bucket_of(F.col("term")))
    blocks.repartition("bucket", F.pmod(F.hash("term"), F.lit(FILES))).sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema("term string, range long, best double, stories long, bucket int").parquet(f"{path}/blocks")
    return BlockIndex(postings, blocks, span, stemmed)


def bounded_ranges(index: BlockIndex, query: str) -> DataFrame:
    """(range, bound) of the ranges that may hold a match, from the query's own blocks."""
    if not textindex.answerable(query, index.stemmed):
        raise ValueError("a query that only negates cannot start from the inverted table")
    groups = [[t for t in g if not t.negated] for g in fulltext.parse_query(query, index.stemmed)]
    words = sorted({w for g in groups for t in g for w in t.words})
    if not words:
        return index.blocks.filter(F.lit(False)).select("range", F.col("best").alias("bound"))
    number = {w: i for i, w in enumerate(words)}
    own = index.blocks.filter(F.col("bucket").isin(*[textindex.bucket_of(F.lit(w)) for w in words]) & F.col("term").isin(*words))
    rows = own.groupBy("range").agg(*[F.max(F.when(F.col("term") == w, F.col("best"))).alias(f"best{i}") for w, i in number.items()])
    must = [reduce(Column.__and__, [F.col(f"best{number[w]}").isNotNull() for t in g for w in t.words]) for g in groups]
    bound = reduce(Column.__add__, [F.coalesce(F.col(f"best{i}"), F.lit(0.0)) for i in number.values()])
    return rows.filter(reduce(Column.__or__, must)).select("range", (bound + 1e-6).alias("bound"))  # ranks are rounded to six places


def matching(index: BlockIndex, query: str, ranges: list[int] | None = None) -> DataFrame:
    """(story_id, rank) of the matches in these ranges, or in all."""
    rows = index.postings
    if ranges is not None:
        rows = rows.filter(F.col("slot").isin(*[_slot_of(F.lit(r)) for r in ranges]) & F.col("range").isin(ranges)) if ranges else rows.filter(F.lit(False))
    return textindex.matching(rows.withColumn("bucket", textindex.bucket_of(F.col("term"))), query, index.stemmed)


def search(stories: DataFrame, index: BlockIndex, f: SearchFilters, story_fandoms: DataFrame | None = None, fandoms: DataFrame | None = None, first: int = FIRST, most: int = MOST, looks: list[int] | None = None) -> DataFrame:
    """The page in order of rank, equal to the scan's. `looks` is given the number of ranges that each look read. Between
    looks the driver holds at most `most` + 1 range numbers and two values of the page."""
    if f.vector is not None or not f.query or f.sort != "relevance" or f.stemmed != index.stemmed:
        raise ValueError("the block index answers text queries in order of rank, with the tokens that it was written for")
    rows = with_ratio(filtered(stories, replace(f, query=""), story_fandoms, fandoms))
    offset, size = window_of(f)
    ranges = bounded_ranges(index, f.query)
    wanted = first
    while wanted <= most:
        head = ranges.orderBy(F.col("bound").desc(), F.col("range").desc()).limit(wanted + 1).collect()
        chosen = [r.range for r in head[:wanted]]
        if looks is not None:
            looks.append(len(chosen))
        own = rows.filter(F.col("story_id").between(min(chosen) * index.span, max(chosen) * index.span + index.span - 1)) if chosen else rows
        page = own.join(matching(index, f.query, chosen), "story_id").orderBy(*order_of(f)).limit(offset + size)
        if len(head) > wanted:
            seen = page.agg(F.count("*").alias("n"), F.min("rank").alias("last")).first()
            if seen.n < offset + size or seen.last <= head[wanted].bound:
                wanted *= GROWTH
                continue
        return page.orderBy(*order_of(f)).offset(offset)
    return rows.join(matching(index, f.query), "story_id").orderBy(*order_of(f)).offset(offset).limit(size)
