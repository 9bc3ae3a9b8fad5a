"""Exact nearest neighbours by Hamming distance, from multi-index hash tables over sign bits.

A vector's bits are cut into chunks of 16. The index holds each vector once per chunk, in folders by chunk and the highest
bits of the chunk's value. If two vectors differ in at most m (r + 1) - 1 bits, with m chunks, one chunk differs in at most r
bits. So all vectors up to that distance are among those with a chunk within r of the query's: the radius grows until k of
them pass the filters, and the k nearest are proven. Only folders within the radius are read. Beyond MOST_RADIUS the
probed part of the table would not be small any more, and one scan of the packed bits takes over; both ways give the same
rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import vectors
from storyloom.operators.filters import SearchFilters, filtered
from storyloom.operators.search import order_of, shortlist, window_of, with_ratio
from storyloom.schema import SHORTLIST_FACTOR, SHORTLIST_LEAST, sign_bits

CHUNK = 16
#: Folders are made for so many of a chunk's highest bits; fewer suit tables under some ten million vectors.
SLOT_BITS = 8
#: Of 65,536 values of a chunk 2,517 are within 4 bits, about 4%.
MOST_RADIUS = 4


def _value(bits: Column, chunk: int) -> Column:
    return F.shiftrightunsigned(bits[chunk * CHUNK // 64], chunk * CHUNK % 64).bitwiseAND((1 << CHUNK) - 1).cast("int")


def write_index(stories: DataFrame, path: str, dims: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The index of the stories that have a vector: chunk, slot, value, story_id, bits. dims is a multiple of 64."""
    bits = F.col("summary_embedding_bits") if "summary_embedding_bits" in stories.columns else sign_bits(F.col("summary_embedding"))
    rows = stories.filter(F.col("summary_embedding").isNotNull()).select("story_id", bits.alias("bits"))
    chunks = F.array(*[F.struct(F.lit(c).alias("chunk"), _value(F.col("bits"), c).alias("value")) for c in range(dims // CHUNK)])
    parts = rows.select("story_id", "bits", F.explode(chunks).alias("c")).select(F.col("c.chunk").alias("chunk"), F.shiftright("c.value", CHUNK - slot_bits).alias("slot"), "c.value", "story_id", "bits")
    parts.repartition("chunk", "slot").sortWithinPartitions("chunk", "slot", "value").write.partitionBy("chunk", "slot").parquet(path)
    return stories.sparkSession.read.schema("value int, story_id long, bits array<long>, chunk int, slot int").parquet(path)


def probed(index: DataFrame, wanted: Sequence[int], radius: int, slot_bits: int = SLOT_BITS) -> DataFrame:
    """(story_id, hamming) of the vectors with a chunk within the radius of the query's packed bits."""
    values = [(w >> shift) & ((1 << CHUNK) - 1) for w in wanted for shift in range(0, 64, CHUNK)]
    folders, near = [], []
    for c, v in enumerate(values):
        slots = [s for s in range(1 << slot_bits) if (s ^ v >> (CHUNK - slot_bits)).bit_count() <= radius]
        folders.append((F.col("chunk") == c) & F.col("slot").isin(slots))
        near.append((F.col("chunk") == c) & (F.bit_count(F.col("value").bitwiseXOR(F.lit(v))) <= radius))
    rows = index.filter(reduce(Column.__or__, folders)).filter(reduce(Column.__or__, near))
    return rows.select("story_id", vectors.hamming(F.col("bits"), wanted).alias("hamming")).dropDuplicates(["story_id"])


def nearest(index: DataFrame, rows: DataFrame, wanted: Sequence[int], k: int, slot_bits: int = SLOT_BITS, most_radius: int = MOST_RADIUS) -> DataFrame | None:
    """The k rows (story_id and others) that are nearest, with hamming; ties by descending id. None if no radius up to the
    largest proves them."""
    chunks = len(wanted) * 64 // CHUNK
    for radius in range(most_radius + 1):
        safe = chunks * (radius + 1) - 1
        hits = rows.join(probed(index, wanted, radius, slot_bits).filter(F.col("hamming") <= safe), "story_id")
        best = hits.orderBy(F.col("hamming").asc(), F.col("story_id").desc()).limit(k)
        if best.count() == k:
            return best
    return None


def search(stories: DataFrame, index: DataFrame, f: SearchFilters, story_fandoms: DataFrame | None = None, fandoms: DataFrame | None = None, k: int | None = None, slot_bits: int = SLOT_BITS) -> DataFrame:
    """The two-phase search with the index as phase one; the filters stay inside it."""
    rows = with_ratio(filtered(stories, f, story_fandoms, fandoms))
    q = vectors.rounded(f.vector)
    best = nearest(index, rows, vectors.query_bits(q), k or max(SHORTLIST_FACTOR * window_of(f)[1], SHORTLIST_LEAST), slot_bits)
    if best is None:
        best = shortlist(rows, f) if k is None else shortlist(rows, f).orderBy(F.col("hamming").asc(), F.col("story_id").desc()).limit(k)
    offset, size = window_of(f)
    exact = best.withColumn("distance", F.round(vectors.cosine_distance(F.col("summary_embedding"), q), 12))
    return exact.orderBy(*order_of(f)).offset(offset).limit(size)
