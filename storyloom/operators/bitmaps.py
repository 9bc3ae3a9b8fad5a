"""An index of array membership: for each value a bitmap of the stories that hold it.

Story ids fall into blocks of 32,768; a value has a bitmap of 4 KB in each block where it occurs (which Parquet packs well
if it is sparse), made by Spark's own bitmap aggregates. The index is stored in folders by field, sorted by value, so that a
search reads the bitmaps of its own values alone. Any-of is a union, exclusion a difference; counts of values inside a
filter are numbers of common bits. Bitmaps of one block meet by block, so the work grows with the blocks, not with the
stories.

Fields: genres, characters, members (of a bracket group), pairs (two members of one group) and live."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from storyloom.operators.filters import SearchFilters, in_one_group

FIELDS = ("genres", "characters", "members", "pairs", "live")
JOINT = "\x1f"


def _groups(ships: Column) -> Column:
    return F.transform(F.coalesce(ships, F.array().cast("array<array<string>>")), lambda g: F.array_sort(F.array_distinct(g)))


def _pairs(group: Column) -> Column:
    return F.flatten(F.transform(group, lambda a: F.transform(F.filter(group, lambda b: b > a), lambda b: F.concat(a, F.lit(JOINT), b))))


def write_index(stories: DataFrame, path: str) -> DataFrame:
    """field, value, block, bits of all stories."""

    def entries(field: str, values: Column) -> Column:
        known = F.filter(F.array_distinct(F.coalesce(values, F.array().cast("array<string>"))), lambda x: x.isNotNull())
        return F.transform(known, lambda x: F.struct(F.lit(field).alias("field"), x.alias("value")))

    groups = _groups(F.col("ships"))
    live = F.when(F.col("deleted_at").isNull(), F.array(F.lit("live")))
    every = F.concat(entries("genres", F.col("genres")), entries("characters", F.col("characters")), entries("members", F.flatten(groups)), entries("pairs", F.flatten(F.transform(groups, _pairs))), entries("live", live))
    rows = stories.select("story_id", F.explode(every).alias("e")).select("story_id", "e.field", "e.value")
    made = rows.groupBy("field", "value", F.bitmap_bucket_number("story_id").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("story_id")).alias("bits"))
    made.repartition("field", F.pmod(F.col("block"), F.lit(64))).sortWithinPartitions("field", "value", "block").write.partitionBy("field").parquet(path)
    return stories.sparkSession.read.schema("value string, block long, bits binary, field string").parquet(path)


@F.pandas_udf(BinaryType())
def both(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([(np.frombuffer(x, np.uint8) & np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)])


@F.pandas_udf(BinaryType())
def without(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([x if y is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)])


def any_of(index: DataFrame, field: str, values: Sequence[str]) -> DataFrame:
    """block, bits of the stories that hold one of the values."""
    return index.filter((F.col("field") == field) & F.col("value").isin(*values)).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def matching(index: DataFrame, f: SearchFilters) -> DataFrame:
    """block, bits of the live stories that pass the filters on genres, characters and ships. A ship of three members or more
    is not decided by its pairs: see `exact`."""
    now = any_of(index, "live", ["live"])
    ship = sorted(set(f.ship))
    wanted = [(k, v) for k, v in (("genres", f.genres), ("characters", f.characters)) if v]
    wanted += [("members", ship)] if len(ship) == 1 else [("pairs", [f"{a}{JOINT}{b}"]) for i, a in enumerate(ship) for b in ship[i + 1 :]]
    for field, values in wanted:
        now = now.join(any_of(index, field, values).withColumnRenamed("bits", "more"), "block").select("block", both("bits", "more").alias("bits"))
    for field, values in (("genres", f.excluded_genres), ("characters", f.excluded_characters)):
        if values:
            now = now.join(any_of(index, field, values).withColumnRenamed("bits", "less"), "block", "left").select("block", without("bits", "less").alias("bits"))
    return now


def exact(f: SearchFilters) -> bool:
    """Whether matching() alone decides these filters."""
    return len(set(f.ship)) < 3


def story_ids(bitmaps: DataFrame) -> DataFrame:
    """The set bits as story ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                places = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))
                size = len(bits) * 8  # blocks from 1 on count up from 1, the others down from 0
                yield pa.record_batch({"story_id": pa.array(places + (block - 1) * size + 1 if block > 0 else block * size - places, pa.int64())})

    return bitmaps.select("block", "bits").mapInArrow(work, "story_id long")


def counted(bitmaps: DataFrame) -> DataFrame:
    """How many stories match, from the bitmaps alone: one row, total."""
    return bitmaps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("total"))


def facet_counts(index: DataFrame, bitmaps: DataFrame, fields: Sequence[str] = ("genres", "characters")) -> DataFrame:
    """facet, value, count inside a filter: common bits of each value's bitmaps and the filter's."""
    own = index.filter(F.col("field").isin(*fields)).join(bitmaps.withColumnRenamed("bits", "inside"), "block")
    sums = own.groupBy(F.col("field").alias("facet"), "value").agg(F.sum(F.bitmap_count(both("bits", "inside"))).alias("count"))
    return sums.filter(F.col("count") > 0)


def narrowed(stories: DataFrame, index: DataFrame, f: SearchFilters) -> DataFrame:
    """The stories that pass the indexed filters, with all their columns."""
    rows = stories.join(story_ids(matching(index, f)), "story_id", "left_semi")
    return rows if exact(f) else rows.filter(in_one_group("ships", f.ship))
