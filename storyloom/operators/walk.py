"""The resumable archive walk over a log of page outcomes: (surface_key, page_no, outcome, rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.schema import REFRESH_PAGES


def walked(outcomes: DataFrame, state: DataFrame, budget: int | None = None) -> DataFrame:
    """The new state of each surface after its pages beyond last_page, in order, up to the first that ends the walk.

    Only an empty page exhausts a surface; a short one does not. An error stops the surface at the page before. One
    window per surface: a surface is an archive of some thousand pages at most."""
    known = state.select("surface_key", F.col("last_page").alias("from_page"), F.col("rows_ingested").alias("old_rows"), F.col("is_exhausted").alias("was_exhausted"))
    rows = outcomes.join(known, "surface_key", "left").withColumn("from_page", F.coalesce("from_page", F.lit(0))).filter((F.col("page_no") > F.col("from_page")) & ~F.coalesce("was_exhausted", F.lit(False)))
    w = Window.partitionBy("surface_key").orderBy("page_no")
    stops = (F.col("outcome") != "ok") | (F.col("rows") == 0)
    rows = rows.withColumn("n", F.row_number().over(w)).withColumn("ended", F.coalesce(F.max(stops).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    # a gap in the log ends the walk as well: that page was not fetched
    rows = rows.filter(~F.col("ended") & (F.col("page_no") == F.col("from_page") + F.col("n")))
    if budget is not None:
        rows = rows.filter(F.col("n") <= budget)
    good = (F.col("outcome") == "ok") & (F.col("rows") > 0)
    out = rows.groupBy("surface_key").agg(
        F.greatest(F.max("from_page"), F.coalesce(F.max(F.when(good, F.col("page_no"))), F.lit(0))).cast("int").alias("last_page"),
        F.coalesce(F.max((F.col("outcome") == "ok") & (F.col("rows") == 0)), F.lit(False)).alias("is_exhausted"),
        (F.coalesce(F.max("old_rows"), F.lit(0)) + F.sum(F.when(good, F.col("rows")).otherwise(0))).alias("rows_ingested"),
        F.max(F.when(F.col("outcome") != "ok", F.col("outcome"))).alias("last_error"),
    )
    if budget is not None:
        full = rows.groupBy("surface_key").agg(F.count("*").alias("n"), F.max(stops).alias("stopped")).filter((F.col("n") >= budget) & ~F.col("stopped")).select("surface_key", F.lit(True).alias("spent"))
        out = out.join(full, "surface_key", "left").withColumn("last_error", F.when(F.col("spent"), "page budget reached").otherwise(F.col("last_error"))).drop("spent")
    return out


def aborts_all(outcomes: DataFrame) -> DataFrame:
    """The surfaces whose 403 ends the whole crawl."""
    return outcomes.filter(F.col("outcome") == "blocked").select("surface_key").distinct()


def head_pages(outcomes: DataFrame, pages: int = REFRESH_PAGES) -> DataFrame:
    """The refresh: the first pages by update order up to the first empty one; never exhausts."""
    empty = Window.partitionBy("surface_key")
    first = F.min(F.when(F.col("rows") == 0, F.col("page_no"))).over(empty)
    return outcomes.withColumn("first_empty", first).filter((F.col("page_no") <= pages) & (F.col("first_empty").isNull() | (F.col("page_no") < F.col("first_empty")))).drop("first_empty")
