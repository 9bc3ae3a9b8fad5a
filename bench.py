"""Times the headline queries: prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import statistics
import time

from storyloom.plans import corpus
from storyloom.plans.queries import Corpus, plain
from storyloom.session import get_session

RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false", spark__sql__adaptive__coalescePartitions__parallelismFirst="false")
    spark.sparkContext.setLogLevel("ERROR")
    from storyloom.operators import analytics, ingest, search, textindex
    from storyloom.operators.filters import SearchFilters, filtered
    from storyloom.schema import with_derived

    # the derived tables are written once, as ingestion would have left them
    root = f"/tmp/storyloom-bench-{os.getpid()}"
    c = Corpus(spark, sf_dir)
    with_derived(c("stories")).write.mode("overwrite").parquet(f"{root}/stories")
    for name in ("story_fandoms", "fandoms", "pairs", "crawl_state"):
        corpus.load(spark, sf_dir, name).write.mode("overwrite").parquet(f"{root}/{name}")
    stories, bridge, fandoms = (spark.read.parquet(f"{root}/{n}") for n in ("stories", "story_fandoms", "fandoms"))
    lineitem, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders"))
    index = textindex.write_index(stories, f"{root}/index")
    q = c.query_vector
    batch = stories.filter("story_id % 100 = 0").drop("favorites_per_1k_words", "summary_embedding_bits", "first_seen_at", "last_seen_at", "deleted_at", "summary_embedding")
    base = stories.drop("favorites_per_1k_words", "summary_embedding_bits")
    page = SearchFilters(ratings=["K", "T"], excluded_genres=["Horror"], min_words=1000, sort="favorites", page=2)
    queries = {
        "search_page": lambda: search.search(stories, page),
        "fandom_search": lambda: search.search(stories, SearchFilters(fandoms=["Fandom 3"], sort="words"), bridge, fandoms),
        "text_search": lambda: textindex.search(stories, index, SearchFilters(query="the of", sort="relevance")),
        "capped_count": lambda: search.capped_count(filtered(stories, page)),
        "capped_count_lineitem": lambda: search.capped_count(lineitem.filter("l_quantity > 10")),
        "facets_rebuild": lambda: analytics.facets(stories, bridge, fandoms),
        "stats_rebuild": lambda: analytics.stats(stories),
        "vector_two_phase": lambda: search.search(stories, SearchFilters(vector=q, sort="semantic")),
        "upsert_one_percent": lambda: ingest.upsert_stories(base, batch),
        "exclusions": lambda: analytics.exclusions(stories),
        "ship_leaderboard": lambda: analytics.ship_leaderboard(stories),
        "semi_join_orders": lambda: orders.join(lineitem.filter("l_quantity > 45").selectExpr("l_orderkey AS o_orderkey"), "o_orderkey", "left_semi").groupBy("o_orderpriority").count(),
    }
    took = {}
    for name, run in queries.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            plain(run()).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    import shutil

    shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "sum of the medians of warm runs", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
