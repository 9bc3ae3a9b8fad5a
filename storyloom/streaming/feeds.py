"""Structured Streaming forms: the polled feed as idempotent upserts, event-time windows, stateful crawl progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from storyloom.operators.versions import VersionedTable

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_available(frame: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Processes all that is there in micro-batches and ends; a repeated run goes on from the checkpoint."""
    frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def ingest_feed(feed: DataFrame, checkpoint: str, upsert: Callable[[DataFrame], None]) -> None:
    """The hourly poll: overlapping batches are harmless, as the upsert is idempotent."""
    run_available(feed, checkpoint, lambda batch, _: upsert(batch))


def ingest_once(feed: DataFrame, checkpoint: str, table: VersionedTable, name: str, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """The poll for mutations that are not idempotent: a batch's number is committed with its rows, so a batch that is
    handed in again after a failure changes nothing. `name` must stay that of the stream."""
    run_available(feed, checkpoint, lambda batch, number: table.upsert(batch, apply, name, number))


def with_event_time(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", size, step).alias("w"), "event_type").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


PROGRESS = T.StructType([T.StructField("surface_key", T.StringType()), T.StructField("last_page", T.IntegerType()), T.StructField("is_exhausted", T.BooleanType()), T.StructField("rows_ingested", T.LongType()), T.StructField("last_error", T.StringType())])
_STATE = T.StructType(PROGRESS.fields[1:])


def walk_stream(outcomes: DataFrame) -> DataFrame:
    """walked() over a stream of page outcomes: the state of a surface is its row in the crawl state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, done, rows, error = state.get if state.exists else (0, False, 0, None)
        pages = pd.concat(list(frames)).sort_values("page_no")
        for page, outcome, n in zip(pages["page_no"], pages["outcome"], pages["rows"], strict=True):
            if done or page != last + 1:
                continue
            error = None if outcome == "ok" else outcome
            if error:
                break
            if n == 0:
                done = True
            else:
                last, rows = int(page), rows + int(n)
        state.update((last, done, rows, error))
        yield pd.DataFrame({"surface_key": [key[0]], "last_page": [last], "is_exhausted": [done], "rows_ingested": [rows], "last_error": [error]})

    return outcomes.groupBy("surface_key").applyInPandasWithState(step, PROGRESS, _STATE, "update", GroupStateTimeout.NoTimeout)
