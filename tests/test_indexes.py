"""The stored indexes against scans: sign bits and array membership."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyloom.functions import vectors
from storyloom.operators import bitmaps, search, signindex
from storyloom.operators.filters import SearchFilters, filtered


@pytest.fixture(scope="module")
def embedded(spark):
    """Vectors of 128 signs around four centres, so that some are near and most are far; some stories have none."""
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 128))
    rows = []
    for k in range(400):
        v = centres[k % 4].copy()
        v[rng.choice(128, rng.integers(0, 25), replace=False)] *= -1
        rows.append((k, None if k % 9 == 4 else v.tolist(), "complete" if k % 3 else "in_progress", k % 5, k + 1))
    df = spark.createDataFrame(rows, "story_id long, summary_embedding array<float>, status string, favorite_count int, word_count int")
    return df.withColumn("deleted_at", F.when(F.col("story_id") % 13 == 0, F.current_timestamp())), centres


@pytest.mark.parametrize("k", [1, 7, 40, 300])
@pytest.mark.parametrize("status", [None, "complete"])
def test_nearest_by_index_equals_the_scan(spark, tmp_path, embedded, k, status):
    stories, centres = embedded
    index = signindex.write_index(stories, f"{tmp_path}/signs", 128, 3)
    wanted = vectors.query_bits(centres[1].tolist())
    rows = filtered(stories, SearchFilters(vector=centres[1].tolist(), status=status))
    brute = rows.withColumn("hamming", vectors.hamming(search.sign_bits(F.col("summary_embedding")), wanted)).orderBy("hamming", F.col("story_id").desc()).limit(k)
    got = signindex.nearest(index, rows, wanted, k, 3)
    assert (got is None) == (k == 300)  # so many are far, which a scan has to settle
    if got is not None:
        assert [(r.story_id, r.hamming) for r in got.collect()] == [(r.story_id, r.hamming) for r in brute.collect()]
    f = SearchFilters(vector=centres[1].tolist(), status=status, sort="semantic", page_size=5)
    assert [r.story_id for r in signindex.search(stories, index, f, slot_bits=3).collect()] == [r.story_id for r in search.search(stories, f).collect()]


def test_a_probe_reads_its_folders_alone(spark, tmp_path, embedded):
    stories, centres = embedded
    index = signindex.write_index(stories, f"{tmp_path}/signs", 128, 3)
    wanted = vectors.query_bits(centres[0].tolist())
    every, none, one = len(index.inputFiles()), [], []
    for radius, found in ((0, none), (1, one)):
        probe = signindex.probed(index, wanted, radius, 3)
        assert "PartitionFilters: [((" in probe._jdf.queryExecution().executedPlan().toString()
        found += index.join(probe, "story_id", "left_semi").select("story_id").distinct().collect()
        # an upper bound by folders: of each chunk one folder at radius 0, four at radius 1
        slots = [(c, w >> shift & 0xFFFF) for c, (w, shift) in enumerate((w, s) for w in wanted for s in range(0, 64, 16))]
        read = {(c, s) for c, v in slots for s in range(8) if (s ^ v >> 13).bit_count() <= radius}
        assert len(read) == 8 * (1, 4)[radius] and probe.select("story_id").count() <= index.filter(" OR ".join(f"(chunk = {c} AND slot = {s})" for c, s in read)).count()
    assert len(none) <= len(one) < stories.count() and every > 32


@pytest.fixture(scope="module")
def tagged(spark):
    rows = []
    genres, people = ["Humor", "Romance", "Horror", "Drama"], ["A", "B", "C", "D"]
    for k in [*range(-40, 60), 32767, 32768, 32769, 65536, 65537, 10**10]:
        ships = [[people[k % 4], people[(k + 1) % 4], people[k % 4]]] if k % 3 == 0 else [["A", "B", "C"], ["D"]] if k % 3 == 1 else None if k % 2 else []
        rows.append((k, None if k % 11 == 0 else [genres[k % 4], genres[k * k % 3]], [people[k % 4]] if k % 5 else [], ships))
    df = spark.createDataFrame(rows, "story_id long, genres array<string>, characters array<string>, ships array<array<string>>")
    return df.withColumn("deleted_at", F.when(F.col("story_id") % 13 == 1, F.current_timestamp()))


CASES = [
    {}, {"genres": ["Humor", "Drama"]}, {"excluded_genres": ["Romance"]}, {"characters": ["A"], "excluded_characters": ["B"]}, {"genres": ["none"]}, {"excluded_genres": ["none"]},
    {"ship": ["A"]}, {"ship": ["B", "A", "B"]}, {"ship": ["A", "B", "C"]}, {"genres": ["Humor"], "excluded_characters": ["C"], "ship": ["D", "A"]},
]


def test_bitmaps_equal_the_scan(spark, tmp_path, tagged):
    index = bitmaps.write_index(tagged, f"{tmp_path}/bitmaps")
    assert set(r.field for r in index.select("field").distinct().collect()) == set(bitmaps.FIELDS)
    for case in CASES:
        f = SearchFilters(**case)
        want = filtered(tagged, f)
        if case.get("excluded_genres"):  # a story without a list of genres has none of them
            want = want.unionByName(tagged.filter("genres IS NULL AND deleted_at IS NULL")).distinct()
        ids = sorted(r.story_id for r in want.collect())
        assert sorted(r.story_id for r in bitmaps.narrowed(tagged, index, f).collect()) == ids, case
        if bitmaps.exact(f):
            assert bitmaps.counted(bitmaps.matching(index, f)).first().total == len(ids)
    f = SearchFilters(excluded_characters=["A"])
    facets = bitmaps.facet_counts(index, bitmaps.matching(index, f), ["genres"])
    want = filtered(tagged, f).select(F.explode(F.array_distinct("genres")).alias("g")).groupBy("g").count()
    assert sorted((r.value, r["count"]) for r in facets.collect()) == sorted(map(tuple, want.collect()))
    assert bitmaps.write_index(tagged.limit(0), f"{tmp_path}/none").count() == 0


def test_a_search_reads_its_values_alone(spark, tmp_path, tagged):
    index = bitmaps.write_index(tagged, f"{tmp_path}/bitmaps")
    plan = bitmaps.any_of(index, "genres", ["Humor"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "PushedFilters: [IsNotNull(value), EqualTo(value,Humor)]" in plan
