"""Similar titles and names by 3-grams, from stored gram lists with length and prefix filters.

A text is the set of 3-grams that `fulltext.title_similarity` compares. Each set is put in one order of all grams, rare ones
first. If two sets of sizes n and m have Jaccard similarity of at least t, then t n <= m <= n / t, and the first
n - ceil(t n) + 1 grams of one meet the first m - ceil(t m) + 1 of the other. So candidates come from the lists of the
query's rarest grams, and only from rows that stand early in their own text; the other lists are read for candidates
alone, to count what is shared. Sizes are stored, so the similarity is exact and no text is read.

A null text has no grams and is similar to nothing; an empty one has one gram."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as fulltext

#: Folders of the stored lists.
BUCKETS = 64


def bucket_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def needed(threshold: float, size: Column) -> Column:
    """ceil(threshold * size), free of the product's rounding error."""
    return F.ceil(F.lit(threshold) * size - 1e-9)


def grams_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, grams, n): each text's distinct 3-grams and their number; rows without a text are left out."""
    return rows.filter(F.col(text).isNotNull()).select(F.col(key), fulltext.grams(F.col(text)).alias("grams")).withColumn("n", F.size("grams"))


def ordered(sets: DataFrame, key: str) -> DataFrame:
    """(gram, key, n, place, frequency): a row for each gram of each set, place from 0 in the order of (frequency, gram).
    A gram that a third of all texts hold is a skewed key of the join, which adaptive execution splits; a set is regrouped
    by its own key and is as small as its text."""
    each = sets.select(key, "n", F.explode("grams").alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("frequency"))
    listed = each.join(counts, "gram").groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("frequency", "gram"))).alias("all"))
    return listed.select(key, "n", F.posexplode("all").alias("place", "one")).select("one.gram", key, "n", "place", "one.frequency")


def write_index(rows: DataFrame, path: str, key: str = "story_id", text: str = "title") -> DataFrame:
    """Writes the lists, in folders by a hash of the gram and sorted by (gram, n), and returns them as read back. Ranges of
    (bucket, gram, n) are dealt to tasks, so a hot gram's list is split among files."""
    lists = ordered(grams_of(rows, key, text), key).withColumn("bucket", bucket_of(F.col("gram")))
    lists.repartitionByRange("bucket", "gram", "n", key).sortWithinPartitions("bucket", "gram", "n").write.partitionBy("bucket").parquet(path)
    kind = dict(rows.dtypes)[key]
    return rows.sparkSession.read.schema(f"gram string, `{key}` {kind}, n int, place int, frequency long, bucket int").parquet(path)


def similar(index: DataFrame, wanted: str, threshold: float, key: str = "story_id") -> DataFrame:
    """(key, similarity) of all texts whose similarity to the wanted one is at least the threshold (above 0, at most 1),
    rounded to six places. Reads the lists of the wanted text's own grams, and of those the rows of a fitting size."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    own = index.sparkSession.range(1).select(fulltext.grams(F.lit(wanted)).alias("grams")).first().grams
    size = len(own)
    least, most = math.ceil(threshold * size - 1e-9), math.floor(size / threshold + 1e-9)
    every = index.filter(F.col("bucket").isin(*[bucket_of(F.lit(g)) for g in own]) & F.col("gram").isin(own))
    lists = every.filter(F.col("n").between(least, most))
    known = {r.gram: r.frequency for r in every.groupBy("gram").agg(F.max("frequency").alias("frequency")).collect()}  # at most a row per own gram
    rare = sorted(own, key=lambda g: (known.get(g, 0), g))[: size - least + 1]
    starts = lists.filter(F.col("gram").isin(rare) & (F.col("place") <= F.col("n") - needed(threshold, F.col("n")))).select(key).distinct()
    shared = lists.join(starts, key, "left_semi").groupBy(key, "n").agg(F.count("*").alias("shared"))
    value = F.col("shared") / (F.col("n") + size - F.col("shared"))
    return shared.filter(value >= threshold - 1e-12).select(key, F.round(value, 6).alias("similarity"))


def classes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, representative): each row's smallest key with the same lower-case text; rows without a text are left out. Keys
    of one text are counted down before they meet their rows, and a hot text is split by adaptive execution."""
    own = rows.filter(F.col(text).isNotNull()).select(F.col(key), F.lower(text).alias("_text"))
    return own.join(own.groupBy("_text").agg(F.min(key).alias("representative")), "_text").select(key, "representative")


def similar_pairs(rows: DataFrame, threshold: float, key: str, text: str) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b, of all pairs of different lower-case texts with at least the threshold,
    rounded to six places. A text is named by its smallest key; `classes` gives the other keys, which are not paired."""
    unique = rows.filter(F.col(text).isNotNull()).groupBy(F.lower(text).alias("text")).agg(F.min(key).alias("key"))
    sets = grams_of(unique, "key", "text")
    early = ordered(sets, "key").filter(F.col("place") <= F.col("n") - needed(threshold, F.col("n"))).select("gram", "key", "n")
    a, b = early.toDF("gram", "key_a", "n_a"), early.toDF("gram", "key_b", "n_b")
    fits = (F.col("key_a") < F.col("key_b")) & (F.col("n_b") >= needed(threshold, F.col("n_a"))) & (F.col("n_a") >= needed(threshold, F.col("n_b")))
    found = a.join(b, "gram").filter(fits).select("key_a", "key_b").distinct()
    both = found.join(sets.select(F.col("key").alias("key_a"), F.col("grams").alias("grams_a")), "key_a").join(sets.select(F.col("key").alias("key_b"), F.col("grams").alias("grams_b")), "key_b")
    value = F.size(F.array_intersect("grams_a", "grams_b")) / F.size(F.array_union("grams_a", "grams_b"))
    near = both.withColumn("similarity", value).filter(F.col("similarity") >= threshold - 1e-12)
    return near.select(F.col("key_a").alias(f"{key}_a"), F.col("key_b").alias(f"{key}_b"), F.round("similarity", 6).alias("similarity"))
