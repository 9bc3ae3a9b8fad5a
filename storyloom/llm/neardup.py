"""Near duplicates by a multi-index Hamming join over b-bit min-hash signatures.

A document's set are the distinct word shingles of its whole text; equal sets are one node. A node's signature has
CHUNKS x WIDTH symbols of 8 bits, one per min-hash; the distance of two signatures is the number of symbols that differ.
By the pigeonhole principle, signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 = MOST symbols have a chunk with
at most ERRORS = 1 wrong symbols. The allowed errors of a chunk are enumerated by leaving out each symbol in turn, so such
a pair shares a key and none under the distance threshold is missed. Pairs that share a key are compared up to distance
FAR: two sets of Jaccard similarity 0.8 have 10 of 50 wrong symbols on average (deviation 2.8), and the chance that they
share no key is about 2e-6, that they lie beyond FAR about 3e-7.

Nodes that share a key are first linked to one of them (a star); links are confirmed on the full sets, and components are
formed. Then all nodes of every key that still holds several components are compared across components by distance, in
blocks of bounded size, each pair only at the first key it shares; the nodes of pairs that are near meet once more, with
their full sets, and only confirmed links leave a task. Pairs within a component are never needed, so groups of copies cost
a star, and no pair is emitted that is not a link. A hot key is counted map-side, met by a join that splits, and cut into blocks.

Null text counts as empty; a text without words links with nothing. Rows that repeat, and ids with several texts, are
resolved per text: an id with several texts takes part with each, and its rows with words carry the id's one component. Null ids
belong to no pair and are their own kept rows with a null component. Extra columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.ingest import free_name

from .common import WordHashes, discard, mix64, shingle_hashes, slices, stored, utf8
from .components import components

WIDTH, CHUNKS, ERRORS = 5, 10, 1
SYMBOLS = WIDTH * CHUNKS
MOST = CHUNKS * (ERRORS + 1) - 1
#: Pairs with a common key are confirmed on their sets up to this distance.
FAR = 25
#: Link where PERCENT * union <= 100 * intersection.
SHINGLE, PERCENT = 4, 80
#: How many nodes of a key, and how many bytes of what they carry, a task compares others with at once.
BLOCK_ROWS, BLOCK_BYTES = 1024, 32 << 20
#: Where a key carries the number of its chunk and left-out symbol.
TAG = 40
_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 31, (SYMBOLS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, (SYMBOLS, 1), dtype=np.uint32)


def shingle_set(raw: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8; a text of fewer words is one shingle."""
    words = hashes.of(raw.lower().split())  # bytes.lower changes A-Z only, bytes.split parts at ASCII white space
    if not len(words):
        return np.empty(0, dtype=np.uint64)
    if len(words) < size:
        return mix64(shingle_hashes(words, len(words)), len(words))
    return np.unique(shingle_hashes(words, size))


def signature(shingles: np.ndarray) -> bytes:
    least = np.full(SYMBOLS, np.iinfo(np.uint32).max, dtype=np.uint32)
    high = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(high), 1024):
        block = _A * high[at : at + 1024]
        block += _B
        np.minimum(least, block.min(axis=1), out=least)
    return (mix64(least.astype(np.uint64)) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(n, SYMBOLS) uint8 to (n, CHUNKS * WIDTH) keys: each chunk without each of its symbols."""
    parts = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.int64)
    keys = np.empty((len(signatures), CHUNKS, WIDTH), dtype=np.int64)
    for left_out in range(WIDTH):
        key = np.zeros(parts.shape[:2], dtype=np.int64)
        for k in range(WIDTH):
            if k != left_out:
                key = (key << 8) | parts[:, :, k]
        keys[:, :, left_out] = key | ((np.arange(CHUNKS, dtype=np.int64) * WIDTH + left_out) << TAG)
    return keys.reshape(len(signatures), -1)


def features(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, mark (a hash of the text), n_shingles, digest of the set, signature (both null for an empty set) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingle_set(raw, words, size) for raw in utf8(part.column("text"))]
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "mark": part.column("mark"),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        "signature": pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    }
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "id long, mark long, n_shingles long, digest binary, signature binary")


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype=np.uint8).reshape(-1, SYMBOLS)


def keyed(nodes: DataFrame) -> DataFrame:
    """(node, signature) to one row per key: key, node."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = chunk_keys(_matrix(part.column("signature").to_pylist()))
                rows = np.repeat(part.column("node").to_numpy(), keys.shape[1])
                yield pa.record_batch({"key": pa.array(keys.ravel()), "node": pa.array(rows)})

    return nodes.select("node", "signature").mapInArrow(work, "key long, node long")


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in at most FAR symbols."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                a, b = (_matrix(part.column(k).to_pylist()) for k in ("of_a", "of_b"))
                yield part.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= FAR))

    for k in "ab":
        pairs = pairs.join(nodes.select(F.col("node").alias(k), F.col("signature").alias(f"of_{k}")), k)
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(work, "a long, b long")


def member_sets(df: DataFrame, id_col: str, text_col: str, size: int, owners: DataFrame) -> DataFrame:
    """node, members (the set's hashes) of the owners (node, id, digest), from their texts; a stored table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            for part in slices(batch, "text"):
                nodes, found = [], []
                for node, wanted, raw in zip(part.column("node").to_pylist(), part.column("digest").to_pylist(), utf8(part.column("text")), strict=True):
                    s = shingle_set(raw, words, size)
                    if xxhash.xxh3_128_digest(s.tobytes()) == wanted:  # an id may have other texts
                        nodes.append(node)
                        found.append(s.tobytes())
                yield pa.record_batch({"node": pa.array(nodes, pa.int64()), "members": pa.array(found, pa.binary())})

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(owners.select("node", "id", "digest"), "id")
    return stored(texts.select("node", "digest", "text").mapInArrow(sets, "node long, members binary").dropDuplicates(["node"]), "members")


def _set(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype=np.uint64)


def confirmed(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist(), strict=True)):
                both = len(np.intersect1d(_set(x), _set(y), assume_unique=True))
                if 100 * both >= percent * ((len(x) + len(y)) // 8 - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    for k in "ab":
        pairs = pairs.join(members.select(F.col("node").alias(k), F.col("members").alias(f"of_{k}")), k)
    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(verify, "a long, b long")


class Held:
    """Nodes of a block: numbers, components, and what is compared."""

    def __init__(self, ids: np.ndarray, components_: np.ndarray, values: list[bytes]):
        self.ids, self.components, self.values = ids, components_, values

    def part(self, rows: np.ndarray) -> Held:
        return Held(self.ids[rows], self.components[rows], [self.values[k] for k in rows])

    @staticmethod
    def of(parts: list[Held]) -> Held:
        return parts[0] if len(parts) == 1 else Held(np.concatenate([p.ids for p in parts]), np.concatenate([p.components for p in parts]), [s for p in parts for s in p.values])


def near_nodes(probes: Held, targets: Held, key: int) -> list[tuple[int, int, int]]:
    """(key, node, component) of the nodes of pairs across components that are near and share `key` as their first key."""
    a, b, found = _matrix(probes.values), _matrix(targets.values), set()
    for lo in range(0, len(a), 64):
        for at in range(0, len(b), 512):
            diff = a[lo : lo + 64, None, :] != b[None, at : at + 512, :]
            near = (np.count_nonzero(diff, axis=2) <= FAR) & (probes.components[lo : lo + 64, None] != targets.components[None, at : at + 512])
            p, t = np.nonzero(near)
            if not len(p):
                continue
            own = diff[p, t].reshape(-1, CHUNKS, WIDTH)
            first = (own.sum(axis=2) <= ERRORS).argmax(axis=1)
            mine = first * WIDTH + own[np.arange(len(p)), first].argmax(axis=1) == key >> TAG
            found.update((key, int(probes.ids[k]), int(probes.components[k])) for k in np.unique(p[mine]) + lo)
            found.update((key, int(targets.ids[k]), int(targets.components[k])) for k in np.unique(t[mine]) + at)
    return list(found)


def cross_links(percent: int):
    """For each probe one confirmed link to every other component that has a target similar enough."""

    def links(probes: Held, targets: Held, key: int) -> list[tuple[int, int]]:
        out = []
        sets = [_set(x) for x in targets.values]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        for lo in range(0, len(probes.ids), 64):
            own = [_set(x) for x in probes.values[lo : lo + 64]]
            own_sizes = np.array([len(s) for s in own], dtype=np.int64)
            words = np.unique(np.concatenate(own))
            has = np.zeros((len(words) + 1, len(own)), dtype=np.uint16)
            for k, s in enumerate(own):
                has[np.searchsorted(words, s), k] = 1
            for at in range(0, len(sets), 512):
                rows = slice(at, at + 512)
                every, doc = np.concatenate(sets[rows]), np.repeat(np.arange(len(sizes[rows])), sizes[rows])
                place = np.searchsorted(words, every)
                place[place == len(words)] = 0
                hit = words[place] == every
                if not hit.any():
                    continue
                doc, place = doc[hit], place[hit]
                first = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
                both = np.add.reduceat(has[place], first, axis=0, dtype=np.int64)
                which = doc[first] + at
                near = 100 * both >= percent * (sizes[which][:, None] + own_sizes[None, :] - both)
                near &= targets.components[which][:, None] != probes.components[None, lo : lo + 64]
                seen = set()
                for t, p in np.argwhere(near):
                    if (p, c := targets.components[which[t]]) not in seen:
                        seen.add((p, c))
                        ends = (int(probes.ids[lo + p]), int(targets.ids[which[t]]))
                        out.append((min(ends), max(ends)))
        return out

    return links


def in_blocks(rows: DataFrame, values: DataFrame, compare: Callable[[Held, Held, int], list[tuple]], schema: str) -> DataFrame:
    """Compares rows (key, node, component) across components within each key: compare(probes, targets, key). values
    (node, value) meet them after they are dealt.

    A key's rows are dealt to blocks of about BLOCK_ROWS targets, or fewer that carry BLOCK_BYTES. Its nodes outside its largest component are the probes;
    where a key has several blocks, they go to each and stream past the targets."""
    sized = rows.join(values.select("node", F.octet_length("value").alias("bytes")), "node")
    counted = sized.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).groupBy("key").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max("n").alias("most"), F.max_by("component", F.struct("n", "component")).alias("main"))
    groups = counted.filter(F.col("n") > F.col("most")).select("key", "main", F.ceil(F.greatest(F.col("n") / BLOCK_ROWS, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    met = rows.join(groups, "key")
    targets = met.withColumn("probe", F.lit(False)).withColumn("at", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    probes = met.filter((F.col("blocks") > 1) & (F.col("component") != F.col("main"))).withColumn("probe", F.lit(True)).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = targets.unionByName(probes).withColumn("block", F.xxhash64("key", "at")).select("block", "probe", "key", "node", "component", "main", "blocks").join(values, "node")
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, many, key, main = None, [], False, 0, 0

        def finished() -> list[tuple]:
            if many or not held:
                return []
            every = Held.of(held)
            others = np.flatnonzero(every.components != main)
            return compare(every.part(others), every, key) if len(others) and len(every.ids) > 1 else []

        def told(found: list[tuple]) -> Iterator[pa.RecordBatch]:
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            block, probe = batch.column("block").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (probe[1:] != probe[:-1])) + 1).tolist(), len(block)]
            found = []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if block[lo] != now:
                    found += finished()
                    now, held, many, key, main = block[lo], [], part.column("blocks")[0].as_py() > 1, part.column("key")[0].as_py(), part.column("main")[0].as_py()
                own = Held(part.column("node").to_numpy(), part.column("component").to_numpy(), part.column("value").to_pylist())
                if not probe[lo]:
                    held.append(own)
                elif held:
                    held = [Held.of(held)]
                    found += compare(own, held[0], key)
            yield from told(found)
        yield from told(finished())

    return dealt.repartition("block").sortWithinPartitions("block", "probe").mapInArrow(work, schema)


def remaining_links(met: DataFrame, labels: DataFrame, nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) between different components of nodes (key, node) that share a key; a stored table."""
    named = met.select("key", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter(F.col("lo") < F.col("hi")).select("key")
    signed = nodes.select("node", F.col("signature").alias("value"))
    near = stored(in_blocks(named.join(mixed, "key"), signed, near_nodes, "key long, node long, component long").distinct(), "near")
    members = sets(near.select("node").distinct())
    whole = members.select("node", F.col("members").alias("value"))
    return stored(in_blocks(near, whole, cross_links(percent), "a long, b long").distinct(), "links", drop=(near, members))


def grouped(df: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's id, mark, n_shingles, digest; and digest, cluster (by links alone), component_id (the smallest id that
    is reachable by links and common ids)."""
    rows = stored(features(df, id_col, text_col, size), "features")
    owned = rows.filter(F.col("digest").isNotNull() & F.col("id").isNotNull())
    reps = owned.groupBy("digest").agg(F.min("id").alias("id"), F.first("signature").alias("signature"))
    nodes = stored(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets(wanted: DataFrame) -> DataFrame:
        return member_sets(df, id_col, text_col, size, nodes.join(wanted, "node", "left_semi"))

    keys = keyed(nodes)
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    met = stored(keys.join(hubs, "key"), "keys")
    star = met.filter(F.col("node") != F.col("hub")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    pairs = stored(near_pairs(star, nodes), "pairs")
    members = sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    edges = stored(confirmed(pairs, members, percent), "links", drop=(pairs, members))
    labels = components(edges).withColumnRenamed("id", "node")
    more = remaining_links(met, labels, nodes, sets, percent)
    discard(met)
    clusters = components(edges.unionByName(more)).withColumnRenamed("id", "node")
    # texts that share an id belong together too
    placed = owned.join(nodes.select("digest", "node"), "digest").select("id", "node")
    several = placed.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("id", "a")
    same = stored(placed.join(several, "id").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), "links")
    whole = clusters if same.isEmpty() else components(edges.unionByName(more).unionByName(same)).withColumnRenamed("id", "node")
    least = nodes.select("node", "id").join(whole, "node").groupBy("component").agg(F.min("id").alias("least"))
    lows = whole.join(least, "component").select("node", "least")
    named = nodes.join(lows, "node", "left").join(clusters.withColumnRenamed("component", "cluster"), "node", "left")
    return rows.drop("signature"), named.select("digest", F.coalesce("cluster", "node").alias("cluster"), F.coalesce("least", "id").alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id, kept."""
    rows, named = grouped(df, id_col, text_col, size, percent)
    out = rows.join(named, "digest", "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))).withColumnRenamed("id", id_col)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of df for each group of linked texts: that with the smallest id (of an id's several texts in a group, one).
    Texts that nothing links stay, each once per id; rows with a null id stay."""
    rows, named = grouped(df, id_col, text_col, size, percent)
    rows = rows.filter(F.col("id").isNotNull())
    own_id, own_mark, place = (free_name(x, df) for x in ("_near_id", "_near_mark", "_near_n"))
    best = rows.join(named, "digest").groupBy("cluster").agg(F.min(F.struct("id", "mark")).alias("x")).select("x.id", "x.mark")
    kept = best.unionByName(rows.filter(F.col("digest").isNull()).select("id", "mark")).distinct().select(F.col("id").alias(own_id), F.col("mark").alias(own_mark))
    once = Window.partitionBy(own_id, own_mark).orderBy(own_mark)
    held = df.filter(F.col(id_col).isNotNull()).withColumn(own_id, F.col(id_col).cast("long")).withColumn(own_mark, F.xxhash64(text_col))
    one = held.join(kept, [own_id, own_mark], "left_semi").withColumn(place, F.row_number().over(once)).filter(F.col(place) == 1)
    return one.select(*df.columns).unionByName(df.filter(F.col(id_col).isNull()))
