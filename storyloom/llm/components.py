"""Connected components of a graph that lies in a table, without bringing edges or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored

ROUNDS = 60


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of one partition as stars: each node with the smallest that it reaches within the partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        part = nodes[at : at + 100_000]
        yield pa.record_batch({"u": pa.array(part, pa.int64()), "v": pa.array(map(root, part), pa.int64())})


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs to (id, component): for each end of an edge the smallest id reachable.

    Each partition first contracts its own edges. Then alternating large-star and small-star rounds: each node hooks its neighbours to the smallest among them, which takes
    a number of rounds logarithmic in the longest path. Every round reads one stored table and writes the next, so a
    lost executor costs a part of one round. A hub's neighbours are aggregated map-side to one minimum before they meet.
    """
    now = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = stored(now.mapInArrow(contracted, "u long, v long").filter(F.col("u") != F.col("v")), "edges")
    before = None
    for _ in range(ROUNDS):
        # large star: every larger neighbour of u gets the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hooked = both.join(least, "u").filter(F.col("v") >= F.col("m"))
        large = hooked.select(F.greatest("u", "v").alias("u"), "m").filter(F.col("u") != F.col("m")).distinct()
        # small star: u and its smaller neighbours get the smallest of them
        lower = large.groupBy("u").agg(F.min("m").alias("low"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("m").alias("u"), F.col("low").alias("v")))).alias("e"))
        after = small.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()
        told = Observation()
        now = stored(after.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges", drop=(now,))
        if before == (before := (told.get["n"], told.get["sum"])):  # a fixed point: every edge leads to a root
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    leaves = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return leaves.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
