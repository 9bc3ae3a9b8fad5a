"""Gram lists and block maxima against scans."""

import random

import pytest
from pyspark.sql import functions as F

from storyloom.functions import text as fulltext
from storyloom.operators import gramindex, search, textindex, topktext
from storyloom.operators.filters import SearchFilters

TITLES = ["The Boy Who Lived", "The Boy Who Died", "the boy who lived", "Boy", "", None, "A", "Ünïcode Ωmega", "💫 stars", "aaaaaaaaaaaa", "aaaa", "The  Boy", "Who Lived: the Boy", "x" * 3000, "The Girl Who Lived", "The Boy Who Lived"]


def brute_grams(title):
    padded = f"  {title.lower()} "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def brute(a, b):
    x, y = brute_grams(a), brute_grams(b)
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def titles(spark):
    rng = random.Random(4)
    words = "the boy girl who lived died of in dark light moon stone and".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    rows = list(enumerate(TITLES + made))
    return spark.createDataFrame(rows, "story_id long, title string"), rows


@pytest.mark.parametrize("threshold", [0.05, 0.3, 0.5, 0.8, 1.0])
def test_similar_titles_equal_brute_force(spark, tmp_path, titles, threshold):
    df, rows = titles
    index = gramindex.write_index(df, f"{tmp_path}/grams")
    for wanted in ("The Boy Who Lived", "", "a", "who lived in the dark", "nothing like it", "aaaaaa", "x" * 3000, "💫"):
        found = {(r.story_id, r.similarity) for r in gramindex.similar(index, wanted, threshold).collect()}
        assert found == {(k, round(brute(t, wanted), 6)) for k, t in rows if t is not None and brute(t, wanted) >= threshold - 1e-12}, wanted


def test_similar_titles_read_gram_folders_and_no_text(spark, tmp_path, titles):
    index = gramindex.write_index(titles[0], f"{tmp_path}/grams")
    plan = gramindex.similar(index, "boy", 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "title:string" not in plan and "GreaterThanOrEqual(n," in plan
    assert gramindex.write_index(titles[0].limit(0), f"{tmp_path}/none").count() == 0
    assert gramindex.similar(gramindex.write_index(titles[0].limit(0), f"{tmp_path}/none2"), "boy", 0.5).count() == 0
    for wrong in (0, -1, 1.1):
        with pytest.raises(ValueError):
            gramindex.similar(index, "boy", wrong)


@pytest.mark.parametrize("threshold", [0.4, 0.7, 1.0])
def test_similar_pairs_equal_brute_force(spark, titles, threshold):
    df, rows = titles
    extra = df.withColumn("text", F.lit(1)).withColumn("gram", F.lit("x"))  # names of helper columns do not clash
    got = gramindex.similar_pairs(extra, threshold, "story_id", "title").collect()
    found = {(r.story_id_a, r.story_id_b, r.similarity) for r in got}
    first = {}
    for k, t in rows:
        if t is not None:
            first.setdefault(t.lower(), k)
    known = [(k, t) for t, k in first.items()]
    assert len(got) == len(found)
    assert found == {(i, j, round(brute(a, b), 6)) for i, a in known for j, b in known if i < j and brute(a, b) >= threshold - 1e-12}
    members = {(r.story_id, r.representative) for r in gramindex.classes(extra, "story_id", "title").collect()}
    assert members == {(k, first[t.lower()]) for k, t in rows if t is not None}


@pytest.fixture(scope="module")
def stories(spark):
    """Most stories hold a word once; a few ranges hold it often, so that their bound stands out."""
    rng = random.Random(9)
    words = "oak elm fox owl moon sea stone wind".split()
    rows = []
    for k in range(600):
        summary = " ".join(rng.choice(words) for _ in range(rng.randint(0, 8)))
        if k in (37, 38, 301, 302, 303):
            summary = "fox owl " * (20 + k % 3)
        rows.append((k, None if k % 50 == 7 else f"tale {rng.choice(words)}", "Ann", None if k % 60 == 11 else summary, k % 4, k % 9 + 1))
    df = spark.createDataFrame(rows, "story_id long, title string, author_name string, summary string, favorite_count int, word_count int")
    return df.withColumn("deleted_at", F.when(F.col("story_id") % 29 == 0, F.current_timestamp())).withColumn("status", F.when(F.col("story_id") % 3 == 0, "complete").otherwise("in_progress"))


@pytest.mark.parametrize("query", ["fox", "fox owl", '"fox owl" or sea', "fox -moon", "absent", "tale ann", "sea absent or oak elm"])
def test_the_page_by_blocks_equals_the_scan(spark, tmp_path, stories, query):
    index = topktext.write_index(stories, f"{tmp_path}/blocks", span=10)
    for page, size, status in ((1, 3, None), (1, 25, "complete"), (3, 7, None), (40, 25, None)):
        f = SearchFilters(query=query, sort="relevance", page=page, page_size=size, status=status)
        wanted = [r.story_id for r in search.search(stories, f).collect()]
        for most in (topktext.MOST, 4)[: 2 if page == 1 and size == 3 else 1]:  # the second gives up early and reads all postings
            assert [r.story_id for r in topktext.search(stories, index, f, first=2, most=most).collect()] == wanted, (page, size, status, most)


def test_ranges_that_cannot_enter_the_page_stay_unread(spark, tmp_path, stories):
    index = topktext.write_index(stories, f"{tmp_path}/blocks", span=10)
    f = SearchFilters(query="fox owl", sort="relevance", page_size=4)
    looks = []
    page = topktext.search(stories, index, f, first=2, looks=looks)
    assert looks == [2] and index.blocks.select("range").distinct().count() == 60
    assert {r.story_id for r in page.collect()} == {r.story_id for r in search.search(stories, f).collect()} <= {37, 38, 301, 302, 303}
    plan = topktext.matching(index, "fox owl", [3, 30])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan
    bounds = {r.range: r.bound for r in topktext.bounded_ranges(index, "fox owl").collect()}
    best = topktext.matching(index, "fox owl").groupBy(F.floor(F.col("story_id") / 10).alias("range")).agg(F.max("rank").alias("best")).collect()
    assert best and all(r.best < bounds[r.range] for r in best)


def test_odd_block_queries(spark, tmp_path, stories):
    index = topktext.write_index(stories, f"{tmp_path}/blocks", span=10)
    with pytest.raises(ValueError):
        topktext.bounded_ranges(index, "fox or -owl")
    with pytest.raises(ValueError):
        topktext.search(stories, index, SearchFilters(query="fox", sort="updated"))
    assert topktext.search(stories, index, SearchFilters(query='""', sort="relevance")).count() == 0
    none = topktext.write_index(stories.limit(0), f"{tmp_path}/none")
    assert topktext.search(stories.limit(0), none, SearchFilters(query="fox", sort="relevance")).count() == 0
    negative = stories.withColumn("story_id", F.col("story_id") - 300)
    index = topktext.write_index(negative, f"{tmp_path}/negative", span=10)
    f = SearchFilters(query="fox", sort="relevance", page_size=5)
    assert [r.story_id for r in topktext.search(negative, index, f).collect()] == [r.story_id for r in search.search(negative, f).collect()]
    assert textindex.answerable("fox") and fulltext.parse_query("fox")


def test_postings_of_repeated_and_empty_stories_and_their_one_shuffle(spark, monkeypatch):
    """Rows of one id count together, also across batches and slices; words are not shuffled."""
    rows = [(1, "Oak elm oak", "Ann", "elm", None), (1, "elm", None, "oak ELM", None), (2, None, None, None, None), (None, "fox", "", "fox", None), (3, "", "", "", None)]
    rows += [(4, "oak", "Bo", None, None), (5, "fox oak", None, "x y", None)]
    own = spark.createDataFrame(rows, "story_id long, title string, author_name string, summary string, deleted_at timestamp")
    wanted = {(None, "fox", (0,), (), (0,)), (1, "oak", (0, 2), (), (0,)), (1, "elm", (0, 1), (), (0, 1)), (1, "ann", (), (0,), ()), (4, "oak", (0,), (), ()), (4, "bo", (), (0,), ())}
    wanted |= {(5, "fox", (0,), (), ()), (5, "oak", (1,), (), ()), (5, "x", (), (), (0,)), (5, "y", (), (), (1,))}
    found = textindex.postings(own)
    assert {(r.story_id, r.term, tuple(r.a), tuple(r.b), tuple(r.c)) for r in found.collect()} == wanted
    plan = found.groupBy("term", "story_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    arrow = fulltext.with_document(own.orderBy("story_id")).select("story_id", "doc_a", "doc_b", "doc_c").toArrow()
    monkeypatch.setattr(textindex, "WORDS", 2)
    for size in (1, 2, 100):
        out = [r for b in textindex._stories_posted(iter(arrow.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {(r["story_id"], r["term"], tuple(r["a"]), tuple(r["b"]), tuple(r["c"])) for r in out} == wanted and len(out) == len(wanted)
