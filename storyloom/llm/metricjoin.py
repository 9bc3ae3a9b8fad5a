"""Exact n-gram Jaccard join in the metric space of shingle sets, by recursive Voronoi regions.

A document's set are the distinct word shingles of its whole text; equal sets are one node. d(x, y) = 1 - |x & y| / |x | y|
is a metric, and nodes link where d <= EPS = 1 - percent / 100.

First level: the pivots are the single shingles {s}. d(x, {s}) = 1 - 1 / |x| for every shingle of x and 1 for all others,
so the nearest pivots of x are its shingles; its region is the one that is rarest (by counts of 2 ** 16 classes over all
texts, then by hash). The window follows from the triangle inequality with x's first w shingles as the pivot P: a set y
without any of them has d(y, P) = 1, x has d(x, P) = 1 - w / |x|, so d(x, y) >= w / |x|, which exceeds EPS from
w = floor(EPS |x|) + 1 on. Each node is replicated to the regions of its w rarest shingles, and linked nodes meet in one.

Shared regions are cut by size: the empty set is a pivot from which sets that link are at most EPS of the larger size apart,
so a node goes to the band of its size on a scale of steps of 1 / (1 - EPS), and to the next one.

A region first links its members to one of them (a star), which settles groups of copies. Regions that still hold several
components join exactly, a share of the regions first, as their links leave fewer open ones. Those of more than LEAF members are cut again, with about PIVOTS of their documents as pivots:
x belongs to the nearest pivot within RADIUS, else to the far region; by the triangle inequality it is replicated to a
pivot p with d(x, p) <= min(RADIUS, d(x, nearest)) + EPS (+ EPS more for the nearest one's border), and to the far region
from d(x, nearest) > RADIUS - EPS on. That recurs to DEPTH levels while it halves the pairs; what no pivot parts is compared
in blocks of bounded size. Pairs are compared across components by parity sketches first: each shingle flips one of about
|x| bits, so two sketches differ in at most as many bits as the sets do in shingles, and no link is lost; what passes is
confirmed on the full sets, and only confirmed links leave a task.

Null text counts as empty; a text without words links with nothing. Rows that repeat get equal results; an id with
several texts takes part with each and joins what they reach. Null ids belong to no pair and have a null component. Extra
columns stay out of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_words, mix64, shingle_hashes, slices, stored, utf8
from .components import components
from .neardup import Held, confirmed, cross_links, in_blocks

SHINGLE, PERCENT = 3, 90
#: Shingles are counted in 2 ** CLASS_BITS classes of their hash, whatever the size of the corpus.
CLASS_BITS = 16
#: Regions over LEAF members are cut by PIVOTS of their documents (on average), at most DEPTH times.
LEAF, PIVOTS, DEPTH, RADIUS = 512, 8, 4, 0.5
#: One in so many regions joins in the first round.
AHEAD = 8
#: Members of a region that one task routes.
ROUTED = 4096
#: Up to so many nodes (32 bytes each) go to the texts by broadcast when their sets are wanted; more meet by a shuffle.
FEW = 200_000
_LOW = np.uint64((1 << (64 - CLASS_BITS)) - 1)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text in UTF-8; a text of fewer words is one shingle."""
    out = []
    for words in hashed_words([x.lower() for x in texts]):  # bytes.lower changes A-Z only
        if 0 < len(words) < size:
            out.append(mix64(shingle_hashes(words, len(words)), len(words)))
        else:
            out.append(np.unique(shingle_hashes(words, size)))
    return out


def class_ranks(df: DataFrame, text_col: str, size: int) -> np.ndarray:
    """The rank of each class of shingles, rarest first. Tasks count into an array and send its 2 ** CLASS_BITS sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << CLASS_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                every = [shingle_hashes(w, size) for w in hashed_words([x.lower() for x in utf8(part.column("text"))])]
                if every:
                    counts += np.bincount((np.concatenate(every) >> np.uint64(64 - CLASS_BITS)).astype(np.int64), minlength=1 << CLASS_BITS)
        seen = np.flatnonzero(counts)
        yield pa.record_batch({"class": pa.array(seen), "n": pa.array(counts[seen])})

    found = df.select(F.col(text_col).alias("text")).mapInArrow(work, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << CLASS_BITS, dtype=np.int64)
    counts[found["class"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    ranks = np.empty(1 << CLASS_BITS, dtype=np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << CLASS_BITS, dtype=np.uint64)
    return ranks


def rarest(shingles: np.ndarray, ranks: np.ndarray, percent: int) -> np.ndarray:
    """The pivots whose regions a set goes to: its first floor((1 - percent / 100) n) + 1 shingles, rarest class first."""
    order = (ranks[shingles >> np.uint64(64 - CLASS_BITS)] << np.uint64(64 - CLASS_BITS)) | (shingles & _LOW)
    w = len(order) * (100 - percent) // 100 + 1
    return order if w >= len(order) else np.partition(order, w - 1)[:w]


def parity(shingles: np.ndarray) -> bytes:
    """The set's size (4 bytes), and one bit per class of about |x| classes: the parity of its shingles there."""
    bits = 1 << max(6, (len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return len(shingles).to_bytes(4, "little") + np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def near_parity(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these sketches (rows of words, broadcast against each other) may link: sets that link differ in
    at most (100 - percent) / (100 + percent) of their sizes' sum."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    total = sizes_a + sizes_b
    return (differ * (100 + percent) <= (100 - percent) * total) & (100 * np.minimum(sizes_a, sizes_b) >= percent * np.maximum(sizes_a, sizes_b))


def _sizes(values: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(v[:4], "little") for v in values], dtype=np.int64)


def _sketches(values: list[bytes], width: int) -> np.ndarray:
    """Sketches as rows of `width` words; those of twice the width are folded, which keeps the bound."""
    out = np.empty((len(values), width), dtype=np.uint64)
    for k, v in enumerate(values):
        own = np.frombuffer(v, dtype=np.uint64, offset=4)
        out[k] = own if len(own) == width else own[:width] ^ own[width:]
    return out


def near_nodes(percent: int) -> Callable[[Held, Held, int], list[tuple[int, int, int]]]:
    """(key, node, component) of the nodes of pairs across components whose sketches allow a link."""

    def compare(probes: Held, targets: Held, key: int) -> list[tuple[int, int, int]]:
        found: set[tuple[int, int, int]] = set()
        sizes_p, sizes_t = _sizes(probes.values), _sizes(targets.values)
        width_p, width_t = (np.array([(len(v) - 4) // 8 for v in x.values]) for x in (probes, targets))
        for width in np.unique(np.concatenate([width_p, width_t])).tolist():
            # linked sets have sketches of one width, or one has twice the other's
            p, t = (np.flatnonzero((w == width) | (w == 2 * width)) for w in (width_p, width_t))
            if not len(p) or not len(t):
                continue
            a, b = _sketches([probes.values[k] for k in p], width), _sketches([targets.values[k] for k in t], width)
            step = max(1, (1 << 21) // (width * min(len(t), 512)))
            for lo in range(0, len(p), step):
                for at in range(0, len(t), 512):
                    x, y = p[lo : lo + step], t[at : at + 512]
                    near = near_parity(a[lo : lo + step, None], b[None, at : at + 512], sizes_p[x][:, None], sizes_t[y][None, :], percent)
                    near &= probes.components[x][:, None] != targets.components[y][None, :]
                    near &= (width_p[x][:, None] == width) | (width_t[y][None, :] == width)
                    rows, columns = np.nonzero(near)
                    found.update((key, int(probes.ids[k]), int(probes.components[k])) for k in x[np.unique(rows)])
                    found.update((key, int(targets.ids[k]), int(targets.components[k])) for k in y[np.unique(columns)])
        return list(found)

    return compare


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()
            widths = np.array([(min(len(x), len(y)) - 4) // 8 if 2 * min(len(x), len(y)) >= max(len(x), len(y)) else 0 for x, y in zip(a, b, strict=True)])
            keep = []
            for width in np.unique(widths[widths > 0]).tolist():
                rows = np.flatnonzero(widths == width)
                of_a, of_b = [a[k] for k in rows], [b[k] for k in rows]
                keep.append(rows[near_parity(_sketches(of_a, width), _sketches(of_b, width), _sizes(of_a), _sizes(of_b), percent)])
            yield batch.select(["a", "b"]).take(pa.array(np.sort(np.concatenate(keep)) if keep else [], pa.int64()))

    for k in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(k), F.col("parity").alias(f"of_{k}")), k)
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def features(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, ranks: np.ndarray) -> DataFrame:
    """id, n_shingles, and for a set that is not empty its digest, rarest shingles and parity sketch."""
    ranks = ranks.astype(np.uint16)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ranks.astype(np.uint64)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(utf8(part.column("text")), size)
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "rarest": pa.array([rarest(s, own, percent).tobytes() if len(s) else None for s in sets], pa.binary()),
                        "parity": pa.array([parity(s) if len(s) else None for s in sets], pa.binary()),
                    }
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, n_shingles long, digest binary, rarest binary, parity binary")


def first_regions(nodes: DataFrame, percent: int) -> DataFrame:
    """(node, rarest, parity) to one row per region: key, node, band of the node's size."""
    step = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1e-9

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                keys = [np.frombuffer(x, dtype=np.int64) for x in part.column("rarest").to_pylist()]
                each = [len(k) for k in keys]
                bands = np.floor(np.log(_sizes(part.column("parity").to_pylist())) / step).astype(np.int64)
                yield pa.record_batch({"key": pa.array(np.concatenate(keys)), "node": pa.array(np.repeat(part.column("node").to_numpy(), each)), "band": pa.array(np.repeat(bands, each))})

    return nodes.select("node", "rarest", "parity").mapInArrow(work, "key long, node long, band long")


def member_sets(df: DataFrame, id_col: str, text_col: str, size: int, owners: DataFrame) -> DataFrame:
    """node, members (the set's hashes) of the owners (node, id, digest), from their texts; a stored table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, found = [], []
                for node, wanted, s in zip(part.column("node").to_pylist(), part.column("digest").to_pylist(), shingle_sets(utf8(part.column("text")), size), strict=True):
                    if xxhash.xxh3_128_digest(s.tobytes()) == wanted:  # an id may have other texts
                        nodes.append(node)
                        found.append(s.tobytes())
                yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "members": pa.array(found, pa.binary())})

    wanted = stored(owners.select("node", "id", "digest"), "wanted")
    held = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(held, "id")
    return stored(texts.select("node", "digest", "text").mapInArrow(sets, "node long, members binary").dropDuplicates(["node"]), "members", drop=(wanted,))


def routes(own: np.ndarray, pivots: list[np.ndarray], eps: float, radius: float) -> list[int]:
    """The regions that a set goes to: numbers of pivots, and -1 for the far region."""
    d = np.empty(len(pivots))
    for k, p in enumerate(pivots):
        both = len(np.intersect1d(own, p, assume_unique=True))
        d[k] = 1 - both / (len(own) + len(p) - both)
    least, slack = d.min(), 1e-9  # rounding may only widen a window
    out = np.flatnonzero(d <= min(radius + eps, least + 2 * eps) + slack).tolist()
    return out + [-1] if least > radius - eps - slack else out


def routed(rows: DataFrame, eps: float, radius: float) -> DataFrame:
    """(block, pivot, key, node, value) to (key, node, cell); a block's pivots come before its members."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, pivots = None, [], []
        for batch in batches:
            keys, nodes, cells = [], [], []
            for block, pivot, key, node, value in zip(*(batch.column(c).to_pylist() for c in ("block", "pivot", "key", "node", "value")), strict=True):
                if block != now:
                    now, names, pivots = block, [], []
                own = np.frombuffer(value, dtype=np.uint64)
                if pivot:
                    names.append(node)
                    pivots.append(own)
                else:
                    for k in routes(own, pivots, eps, radius) if pivots else [-1]:
                        keys.append(key)
                        nodes.append(node)
                        cells.append(names[k] if k >= 0 else -1)
            if keys:
                yield pa.record_batch({"key": pa.array(keys, pa.int64()), "node": pa.array(nodes, pa.int64()), "cell": pa.array(cells, pa.int64())})

    return rows.repartition("block").sortWithinPartitions("block", F.col("pivot").desc()).mapInArrow(work, "key long, node long, cell long")


def cut(regions: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, leaf: int, pivots: int, depth: int, radius: float) -> DataFrame:
    """regions (key, node) with those over `leaf` members cut recursively; a pair within EPS that shares a region shares
    one of the result as well. Regions whose cut leaves more than half of the pairs stay whole. A stored table."""
    eps = 1 - percent / 100
    now, done, members = regions, None, None
    for level in range(depth):
        sizes = now.groupBy("key").agg(F.count("*").alias("n"))
        big = stored(sizes.filter(F.col("n") > leaf), "big")
        if big.isEmpty():
            discard(big)
            break
        rows = stored(now.join(big, "key"), "rows")
        if members is None:
            members = sets(rows.select("node").distinct())
        chosen = F.pmod(F.xxhash64("key", "node", F.lit(level)), F.col("n")) < pivots
        valued = rows.join(members.select("node", F.col("members").alias("value")), "node").withColumn("blocks", F.ceil(F.col("n") / ROUTED).cast("int"))
        whole = valued.withColumn("pivot", F.lit(False)).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        heads = valued.filter(chosen).withColumn("pivot", F.lit(True)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = whole.unionByName(heads).select(F.xxhash64("key", "at").alias("block"), "pivot", "key", "node", "value")
        cells = stored(routed(dealt, eps, radius).withColumn("to", F.xxhash64("key", "cell", F.lit(level))), "cells")
        pairs = cells.groupBy("key", "to").agg(F.count("*").cast("double").alias("m")).groupBy("key").agg(F.sum(F.col("m") * F.col("m")).alias("after"))
        better = big.join(pairs, "key").filter(F.col("after") <= F.col("n").cast("double") * F.col("n") / 2).select("key")
        settled = now.join(big, "key", "left_anti").unionByName(rows.join(better, "key", "left_anti").select("key", "node"))
        after = stored(cells.join(better, "key", "left_semi").select(F.col("to").alias("key"), "node"), "regions")
        done = stored(settled if done is None else done.unionByName(settled), "regions", drop=() if done is None else (done,))
        for old in (big, rows, cells, *([now] if level else [])):
            discard(old)
        now = after
    if done is None:
        return regions
    out = stored(done.unionByName(now), "regions", drop=(done, now))
    discard(members)
    return out


def open_regions(met: DataFrame, labels: DataFrame) -> DataFrame:
    """The regions (key, node, component) that hold several components and more than a star's one pair; of regions with
    the same members one. A stored table."""
    named = met.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    seen = named.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
    once = seen.filter((F.col("lo") < F.col("hi")) & (F.col("n") > 2)).groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    return stored(named.join(once, "key"), "open")


def links(df: DataFrame, id_col: str, text_col: str, size: int, percent: int, nodes: DataFrame, **how) -> DataFrame:
    """Links (a, b) between nodes (node, id, digest, rarest, parity) whose components are those of all links."""

    def sets(wanted: DataFrame) -> DataFrame:
        return member_sets(df, id_col, text_col, size, nodes.join(wanted, "node", "left_semi"))

    keys = first_regions(nodes, percent)
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    banded = keys.join(shared, "key").select(F.explode(F.array(F.xxhash64("key", "band"), F.xxhash64("key", F.col("band") + 1))).alias("key"), "node")
    banded = stored(banded, "banded")
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    met = stored(banded.join(hubs, "key"), "met", drop=(banded,))
    star = met.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(near_pairs(star, nodes, percent), "pairs")
    members = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    edges = stored(confirmed(pairs, members, percent), "links", drop=(pairs, members))
    ahead = F.pmod("key", F.lit(AHEAD)) == 0
    for share in (ahead, ~ahead):
        edges = edges.unionByName(across(met.filter(share), edges, nodes, sets, percent, **how))
    discard(met)
    return edges


def across(met: DataFrame, edges: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, **how) -> DataFrame:
    """Links between components of `edges` that share a region of met (key, node); a stored table."""
    labels = stored(components(edges).withColumnRenamed("id", "node"), "labels")
    left = open_regions(met, labels)
    regions = cut(left.select("key", "node"), sets, percent, **how)
    named = regions.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    sketched = nodes.select("node", F.col("parity").alias("value"))
    near = stored(in_blocks(named.join(several, "key"), sketched, near_nodes(percent), "key long, node long, component long").distinct(), "near")
    once = near.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s")).groupBy("n", "x", "s").agg(F.min("key").alias("key")).select("key")
    members = sets(near.select("node").distinct())
    whole = members.select("node", F.col("members").alias("value"))
    return stored(in_blocks(near.join(once, "key"), whole, cross_links(percent), "a long, b long").distinct(), "links", drop=(near, members, labels))


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, leaf: int = LEAF, pivots: int = PIVOTS, depth: int = DEPTH, radius: float = RADIUS) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the smallest id that links reach)."""
    ranks = class_ranks(df, text_col, size)
    rows = stored(features(df, id_col, text_col, size, percent, ranks), "features")
    owned = rows.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    reps = owned.groupBy("digest").agg(F.min("id").alias("id"), F.first("rarest").alias("rarest"), F.first("parity").alias("parity"))
    nodes = stored(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")
    edges = links(df, id_col, text_col, size, percent, nodes, leaf=leaf, pivots=pivots, depth=depth, radius=radius)
    # texts that share an id belong together too
    placed = owned.select("id", "digest").join(nodes.select("digest", "node"), "digest").select("id", "node")
    several = placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("id", "a")
    same = placed.join(several, "id").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct()
    whole = components(edges.unionByName(same)).withColumnRenamed("id", "node")
    least = nodes.select("node", "id").join(whole, "node").groupBy("component").agg(F.min("id").alias("least"))
    named = nodes.join(whole.join(least, "component").select("node", "least"), "node", "left").select("digest", F.coalesce("least", "id").alias("component_id"))
    out = rows.join(named, "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumnRenamed("id", id_col)
