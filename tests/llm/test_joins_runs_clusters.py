"""The metric-space join, periodic runs and k-means against brute force, and their odd inputs."""

import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storyloom.llm import centroids, metricjoin, periodic, queries

DOCS = "doc_id long, text string, id string, key string, node string, component string, cell string, n string, members string, parity string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in rows], DOCS)


def brute_components(rows, size=3, percent=90):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    low = list(range(len(rows)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] == rows[b][0]
            if sets[a] and sets[b] and None not in (rows[a][0], rows[b][0]) and (same_id or 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])):
                low[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(sets[k]), None if i is None else least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def many_copies(n=160, seed=3):
    """Two texts with a few words changed per copy, on both sides of the limit, around a passage that all share."""
    rng = np.random.default_rng(seed)
    shared = [f"s{k}" for k in range(12)]
    out = []
    for k in range(n):
        base = [f"b{k % 2}x{j}" for j in range(150)]
        for at in rng.choice(150, rng.integers(0, 5), replace=False):
            base[at] = f"e{rng.integers(0, 6)}"
        out.append((k, " ".join(base[:70] + shared + base[70:] if k % 5 else shared + [f"o{k}x{j}" for j in range(3)])))
    return out


@pytest.mark.parametrize("how", [{}, {"leaf": 8, "pivots": 4}, {"leaf": 8, "pivots": 3, "radius": 0.95, "depth": 6}])
def test_join_against_brute_force(spark, how):
    rows = many_copies()
    got = metricjoin.jaccard_components(docs(spark, rows), **how).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_join_takes_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  b"), (6, "a"), (7, long), (8, long + " end"), (8, long + " end"), (9, "x y z"), (9, "q r s t"), (10, "Q R S T"), (None, "x y z"), (11, "é b c"), (12, "É b c")]
    assert sorted(map(tuple, metricjoin.jaccard_components(docs(spark, rows)).collect()), key=str) == brute_components(rows)
    assert metricjoin.jaccard_components(docs(spark, rows).limit(0)).count() == 0


def test_regions_are_cut_and_lose_no_pair(spark):
    """Every pair within the distance that shares a region shares one after the cut, and there are fewer pairs."""
    rng = np.random.default_rng(1)
    sets = {k: np.unique(np.r_[np.arange(100) + 1000 * (k % 6), rng.integers(10**6, 10**9, rng.integers(0, 8))].astype(np.uint64)) for k in range(120)}
    members = spark.createDataFrame([(k, s.tobytes()) for k, s in sets.items()], "node long, members binary")
    regions = spark.createDataFrame([(7, k) for k in sets], "key long, node long")
    from storyloom.llm.common import stored

    found = metricjoin.cut(regions, lambda wanted: stored(members.join(wanted, "node"), "members"), 90, 10, 8, 4, 0.5).collect()
    cells = {}
    for r in found:
        cells.setdefault(r.key, set()).add(r.node)
    near = {(a, b) for a in sets for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.9 * len(np.union1d(sets[a], sets[b]))}
    met = {(a, b) for c in cells.values() for a in c for b in c if b < a}
    assert near <= met and len(met) < 0.6 * 120 * 119 / 2 and set().union(*cells.values()) == set(sets)


@given(st.lists(st.integers(0, 3000), min_size=1, max_size=400, unique=True), st.lists(st.integers(0, 3000), max_size=12), st.integers(0, 12))
def test_parity_never_loses_a_link(own, more, less):
    x = metricjoin.mix64(np.array(sorted(own), dtype=np.uint64))
    y = metricjoin.mix64(np.unique(np.array(own[less:] + more, dtype=np.uint64))) if own[less:] + more else x
    x, y = np.unique(x), np.unique(y)
    a, b = metricjoin.parity(x), metricjoin.parity(y)
    width = (min(len(a), len(b)) - 4) // 8
    if max(len(a), len(b)) - 4 <= 16 * width and 100 * len(np.intersect1d(x, y)) >= 90 * len(np.union1d(x, y)):
        assert metricjoin.near_parity(metricjoin._sketches([a], width), metricjoin._sketches([b], width), metricjoin._sizes([a]), metricjoin._sizes([b]), 90).all()
        ranks = np.random.default_rng(0).permutation(1 << 16).astype(np.uint64)
        assert set(metricjoin.rarest(x, ranks, 90)) & set(metricjoin.rarest(y, ranks, 90))


def brute_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4), st.lists(st.integers(0, 3), max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(1, 8), st.integers(2, 9)), max_size=4))
def test_runs_against_brute_force(letters, text, planted):
    w = [x % letters for x in text]
    for start, q, times in planted:
        for k in range(start + q, min(len(w), start + q * times)):
            w[k] = w[k - q]
    assert periodic.runs([str(x).encode() for x in w]) == brute_runs(w)


def test_runs_of_very_long_texts():
    assert periodic.runs([b"a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs([b"%d" % (k % 40_000) for k in range(170_000)]) == [(0, 170_000, 40_000)]
    assert periodic.runs([b"%d" % k for k in range(100_000)]) == []


def expected_runs(i, text):
    w = queries.periodic_tail(i, (text or "").encode().split())
    found = brute_runs([x.decode() for x in w]) if len(w) < 1500 else periodic.runs(w)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_op12_against_plain_python(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert got == {r.doc_id: expected_runs(r.doc_id, r.text) for r in rows}
    assert any(r[1] for r in got.values())


def test_runs_take_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a a a a a a"), (3, "a a a a a a"), (None, "x y " * 9), (4, "a a a a a"), (5, "É é é é é é é")]
    got = sorted((r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.periodic_runs(docs(spark, rows)).collect())
    assert got == [(0, 18, ((0, 18, 2),), "x y"), (1, 0, (), ""), (2, 0, (), ""), (3, 6, ((0, 6, 1),), "a"), (3, 6, ((0, 6, 1),), "a"), (4, 5, (), "a a a a a"), (5, 7, ((1, 6, 1),), "É é")]
    assert periodic.periodic_runs(docs(spark, rows).limit(0)).count() == 0


def brute_clusters(rows, clusters, rounds, scale=1024, seed="3"):
    v = [(i, [math.floor(scale * x) for x in e]) for i, e in rows]
    order = sorted(v, key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    c = [e for _, e in order[:clusters]]

    def nearest(e):
        return min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = [nearest(e)[1] for _, e in v]
        for j in range(len(c)):
            inside = [e for (_, e), k in zip(v, own, strict=True) if k == j]
            c[j] = [sum(x) // len(inside) for x in zip(*inside, strict=True)] if inside else c[j]
    return sorted((i, nearest(e)[1], nearest(e)[0]) for i, e in v)


@pytest.mark.parametrize("scale", [1, 1024, 10**9])
def test_clusters_against_brute_force(spark, scale):
    """Few values, so that many distances and centroids are equal; at the large scale the integers leave 64 bits."""
    rng = np.random.default_rng(scale % 97)
    rows = [(k, [float(x) for x in rng.integers(-2, 3, 5) * (10 if k % 3 else 1)]) for k in range(200)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, vector string, near int").repartition(3)
    seen: list[int] = []
    out, _, _ = centroids.clustered(df, width=5, clusters=6, rounds=6, scale=scale, history=seen)
    want = brute_clusters(rows, 6, 6, scale)
    assert sorted(map(tuple, out.collect()), key=lambda r: r[0]) == [(i, j, d if d < 1 << 63 else None) for i, j, d in want]
    assert seen[0] == 1200 and sum(seen) < 0.8 * 7 * 1200


def test_bounds_hold_and_pass_over_most():
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.integers(-90, 90, (300, 16)) + 400 * k for k in range(4)])
    c = v[[0, 310, 620, 930, 5]]
    near, upper, lower, _ = centroids.first_assignment(v, c)
    for _ in range(5):
        new = np.stack([v[near == j].sum(axis=0) // max(1, (near == j).sum()) if (near == j).any() else c[j] for j in range(len(c))])
        moved = centroids.up(centroids.root(centroids.squared(c, new))).astype(float)
        half = np.stack([centroids.down(centroids.root(centroids.squared(new, x)) / 2) for x in new])
        near, upper, lower, calculated = centroids.next_assignment(v, new, near, upper, lower, moved, half)
        exact = np.stack([centroids.squared(v, x) for x in new], axis=1)
        true = np.sqrt(exact.astype(float))
        assert (near == exact.argmin(axis=1)).all() and (upper >= true[np.arange(len(v)), near]).all() and (lower <= true).all()
        c = new
    assert calculated.sum() < 0.3 * len(v) * len(c)


def test_clusters_take_odd_rows(spark):
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [1e308] * 64]
    rows = [(k, e) for k, e in enumerate(bad)] + [(20, [1.0] * 64), (20, [1.0] * 64), (None, [2.0] * 64), (21, [1e10] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((r.vec_id or 0, r.distance, r.inertia) for r in centroids.with_inertia(df).collect()))
    assert got == [(0, 0, 0), (20, 0, 0), (20, 0, 0), (21, 0, 0)]
    assert centroids.with_inertia(df.limit(0)).count() == 0 and centroids.with_inertia(df.filter("vec_id < 8")).count() == 0


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op13_centroids"])
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
