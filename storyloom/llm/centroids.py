"""Exact k-means on integer vectors with Elkan's bounds.

Every vector keeps an upper bound of the distance to its centroid and a lower bound for each of the k centroids from
round to round. A round moves the bounds by how far the centroids went, and calculates a distance only where neither the
lower bound nor half the distance between two centroids shows that a centroid is farther. Bounds are float32, rounded up or
down so that they stay bounds; a centroid is passed over only where it is strictly farther, so ties reach the exact
comparison of integers, where the smaller number wins. The last assignment calculates every final distance exactly.

A round reads one stored table and writes the next, so a lost executor costs a part of one round. Tasks add up their
clusters' vectors; k rows a task are aggregated, and k centroids of fixed length reach the driver.

Vectors with another number of components than `width`, or with a null or non-finite one (also after scaling), are left
out. Components become floor(scale * x). Rows that repeat, and null ids, are vectors of their own; of the initial vectors
with one hash the smaller comes first. Fewer than k vectors: as many clusters. Sums are exact up to 38 digits; a distance
beyond a long is null. Extra columns stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

WIDTH, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
#: Squared distances of components under this fit 64 bits at any usual width.
SMALL = 1 << 26
#: Rows worked on at once.
ROWS = 4096
_LONGEST = (1 << 63) - 1


def packed(values: np.ndarray) -> bytes:
    """Integer values as int32, or as doubles (exact: they come from doubles) where one does not fit."""
    return values.astype(np.int32).tobytes() if np.abs(values).max(initial=0) < 1 << 31 else values.tobytes()


def unpacked(rows: list[bytes], width: int) -> np.ndarray:
    """Packed vectors as rows of int64, or of Python integers if one is so large that squares might overflow."""
    if all(len(r) == 4 * width for r in rows):
        out = np.frombuffer(b"".join(rows), dtype=np.int32).reshape(-1, width).astype(np.int64)
        if np.abs(out).max(initial=0) < SMALL:
            return out
        return out.astype(object)
    return np.array([[int(x) for x in np.frombuffer(r, dtype=np.int32 if len(r) == 4 * width else np.float64)] for r in rows], dtype=object)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows."""
    d = a - b
    return (d * d).sum(axis=1)


def up(x: np.ndarray) -> np.ndarray:
    """float32 values that are no smaller than x, also if x has an error of some last places."""
    return np.nextafter((np.asarray(x, dtype=np.float64) * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((np.asarray(x, dtype=np.float64) * (1 - 1e-12)).astype(np.float32), np.float32(-np.inf))


def root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(np.asarray(squares, dtype=np.float64))


def first_assignment(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid, upper bounds, lower bounds, and how many distances were calculated."""
    exact = np.stack([squared(v, x) for x in c], axis=1)
    near = exact.argmin(axis=1)  # the first of equal ones
    return near, up(root(exact[np.arange(len(v)), near])), down(root(exact)), np.full(len(v), len(c))


def next_assignment(v: np.ndarray, c: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for centroids that moved by at most `moved`; half: lower bounds of half their distances."""
    upper, lower = up(upper.astype(np.float64) + moved[near]), np.maximum(down(lower.astype(np.float64) - moved), np.float32(0))
    calculated = np.zeros(len(v), dtype=np.int64)
    near = near.copy()
    rows = np.flatnonzero(upper >= half[near].min(axis=1, where=np.arange(len(c)) != near[:, None], initial=np.inf))
    if not len(rows):
        return near, upper, lower, calculated
    own = squared(v[rows], c[near[rows]])
    calculated[rows] += 1
    upper[rows], lower[rows, near[rows]] = up(root(own)), down(root(own))
    for k in range(len(c)):
        at = near[rows]
        some = np.flatnonzero((at != k) & (upper[rows] >= lower[rows, k]) & (upper[rows] >= half[at, k]))
        if not len(some):
            continue
        which = rows[some]
        found = squared(v[which], c[k])
        calculated[which] += 1
        lower[which, k] = down(root(found))
        better = np.asarray((found < own[some]) | ((found == own[some]) & (k < near[which])), dtype=bool)
        own[some[better]] = found[better]
        near[which[better]] = k
        upper[which[better]] = up(root(found[better]))
    return near, upper, lower, calculated


def _longs(values: np.ndarray) -> list[int | None]:
    return [int(x) if x <= _LONGEST else None for x in values]


STATE = "id {kind}, vector binary, near int, upper float, lower binary, calculated long, distance long, sums array<decimal(38,0)>, n long"


def assigned(state: DataFrame, kind: str, width: int, now: list[list[int]], before: list[list[int]] | None, final: bool) -> DataFrame:
    """The state after an assignment to the centroids `now`, and a row per task and cluster with its sums and count (the
    last one: the sum of its distances)."""
    columns = STATE.format(kind=kind)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = unpacked([packed(np.array(x, dtype=np.float64)) for x in now], width)
        k = len(c)
        moved = half = None
        if before is not None:
            old = unpacked([packed(np.array(x, dtype=np.float64)) for x in before], width)
            moved = up(root(squared(old, c))).astype(np.float64)
            half = np.stack([down(root(squared(c, x)) / 2) for x in c])
        sums, counts = [[0] * (1 if final else width) for _ in range(k)], [0] * k
        schema = None
        for batch in batches:
            schema = batch.schema.field("id").type
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                raw = part.column("vector").to_pylist()
                v = unpacked(raw, width)
                own = c.astype(object) if v.dtype == object else c
                v = v.astype(object) if own.dtype == object else v
                if before is None:
                    near, upper, lower, calculated = first_assignment(v, own)
                else:
                    bounds = np.frombuffer(b"".join(part.column("lower").to_pylist()), dtype=np.float32).reshape(-1, k)
                    near, upper, lower, calculated = next_assignment(v, own, part.column("near").to_numpy().astype(np.int64), part.column("upper").to_numpy(), bounds, moved, half)
                distances = squared(v, own[near]) if final else None
                for j in np.unique(near).tolist():
                    inside = near == j
                    counts[j] += int(inside.sum())
                    for place, x in enumerate([distances[inside].sum()] if final else v[inside].sum(axis=0).tolist()):
                        sums[j][place] += int(x)
                empty = pa.nulls(len(raw))
                yield pa.record_batch(
                    [
                        part.column("id"), part.column("vector"), pa.array(near, pa.int32()), pa.array(upper, pa.float32()), pa.array([x.tobytes() for x in lower], pa.binary()), pa.array(calculated, pa.int64()),
                        pa.array(_longs(distances) if final else [None] * len(raw), pa.int64()), empty.cast(pa.list_(pa.decimal128(38, 0))), empty.cast(pa.int64()),
                    ],
                    names=NAMES,
                )
        full = [j for j in range(k) if counts[j]]
        if full:
            none = pa.nulls(len(full))
            yield pa.record_batch(
                [
                    none.cast(schema), none.cast(pa.binary()), pa.array(full, pa.int32()), none.cast(pa.float32()), none.cast(pa.binary()), none.cast(pa.int64()),
                    none.cast(pa.int64()), pa.array([[Decimal(x) for x in sums[j]] for j in full], pa.list_(pa.decimal128(38, 0))), pa.array([counts[j] for j in full], pa.int64()),
                ],
                names=NAMES,
            )

    return state.mapInArrow(work, columns)


NAMES = [x.split()[0] for x in STATE.split(", ")]


def cluster_sums(told: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """cluster: (vectors, sum of each component), from the tasks' rows."""
    rows = told.filter(F.col("sums").isNotNull())
    counts = {r.near: r.n for r in rows.groupBy("near").agg(F.sum("n").alias("n")).collect()}
    sums: dict[int, dict[int, int]] = {j: {} for j in counts}
    for r in rows.select("near", F.posexplode("sums").alias("place", "x")).groupBy("near", "place").agg(F.sum("x").alias("x")).collect():
        sums[r.near][r.place] = int(r.x)
    return {j: (n, [sums[j][p] for p in sorted(sums[j])]) for j, n in counts.items()}


def prepared(df: DataFrame, id_col: str, vector_col: str, width: int, scale: int) -> DataFrame:
    """id, vector (packed integers) of the vectors that are whole."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                with np.errstate(over="ignore"):
                    values = np.floor(np.asarray(part.column("vector").flatten(), dtype=np.float64).reshape(-1, width) * scale)
                fit = np.isfinite(values).all(axis=1)
                yield pa.record_batch({"id": part.column("id").filter(pa.array(fit)), "vector": pa.array([packed(x) for x in values[fit]], pa.binary())})

    vector = F.col(vector_col).cast("array<double>")
    whole = (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).alias("id"), vector.alias("vector")).filter(F.coalesce(whole, F.lit(False))).mapInArrow(work, f"id {kind}, vector binary")


def initial(vectors: DataFrame, width: int, clusters: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids: at most `clusters` rows."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    best = vectors.orderBy(hashed.asc_nulls_last(), "vector").limit(clusters).select("vector").collect()
    return [[int(x) for x in row] for row in unpacked([bytes(r.vector) for r in best], width)] if best else []


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", width: int = WIDTH, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, history: list[int] | None = None) -> tuple[DataFrame, list[list[int]], dict[int, tuple[int, list[int]]]]:
    """id, cluster, distance of every whole vector; the final centroids; cluster: (vectors, [sum of their distances]).

    history takes how many distances each assignment calculated."""
    kind = df.schema[id_col].dataType.simpleString()
    state = stored(prepared(df, id_col, vector_col, width, scale), "vectors")
    now, before = initial(state, width, clusters, seed), None
    if not now:
        return state.select(F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), [], {}
    told: dict[int, tuple[int, list[int]]] = {}
    for r in range(rounds + 1):
        after = stored(assigned(state, kind, width, now, before, r == rounds), "assigned", drop=(state,))
        told = cluster_sums(after)
        state = after
        state_rows = after.filter(F.col("sums").isNull())
        state_rows.stored_path = after.stored_path
        state = state_rows
        if history is not None:
            history.append(state.agg(F.sum("calculated")).first()[0])
        if r < rounds:
            before, now = now, [[x // told[j][0] for x in told[j][1]] if j in told else c for j, c in enumerate(now)]
    return state.select(F.col("id").alias(id_col), F.col("near").alias("cluster"), "distance"), now, told


def with_inertia(df: DataFrame, **how) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the components in decimal, joined by commas)."""
    rows, centroids, told = clustered(df, **how)
    own = {j: told[j][1][0] if j in told else 0 for j in range(len(centroids))}
    total = sum(own.values())

    def fitting(x: int):
        return F.lit(x if x <= _LONGEST else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    place = F.col("cluster") + 1
    inertia = F.element_at(F.array(*map(fitting, own.values())), place) if own else F.lit(0).cast("long")
    digest = F.element_at(F.array(*map(F.lit, digests)), place) if own else F.lit("")
    return rows.withColumns({"cluster_inertia": inertia, "inertia": fitting(total), "centroid_sha256": digest})
