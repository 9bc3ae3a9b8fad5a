"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from storyloom.llm import audio, bpe, components, html, neardup, packing, quality, queries, secrets, substring, urls, warc

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    width = schema.count(",") + 1
    return spark.createDataFrame([(i, t, *[None] * (width - 2)) for i, t in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    """Null and empty texts, a very long one, repeated rows, a null id, columns that the operators use themselves."""
    long = " ".join(f"w{k % 977}x{k}" for k in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, "token = 'abcdefghijklmnop'"), (5, "token = 'abcdefghijklmnop'"), (None, "no id here"), (6, "é" * 40), (7, "a b c"), (8, "a b c"), (9, "A B\tc")]
    clash = "doc_id long, text string, id string, key string, component string, blob string, findings string, score string, n string, length string, digest string, members string"
    return docs(spark, rows, clash)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_every_operator_takes_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int")
    for one in (
        lambda d: bpe.encode_documents(d, VOCAB), lambda d: audio.audio_features(d), lambda d: secrets.scan(d), lambda d: quality.judge(d, labels), lambda d: quality.judge(d, labels.limit(0)), neardup.near_duplicates,
        lambda d: warc.read_archives(warc.write_archives(d.select("doc_id", "text", F.lit(None).cast("string").alias("url")), warc.archive_folder(spark), "doc_id", "url", "text")), lambda d: html.extract(d, "doc_id", "text", "text"), lambda d: urls.judge(d, labels, "doc_id", "text"),
    ):
        assert one(odd).count() == odd.count()
        assert one(none).count() == 0
    assert substring.repeated_passages(odd).count() == 0 and substring.repeated_passages(none).count() == 0
    assert substring.without_repeats(odd).count() == odd.count() and secrets.redacted(odd).columns == odd.columns
    assert packing.pack(odd, VOCAB).select("doc_id").distinct().count() == odd.select("doc_id").distinct().count() and packing.pack(none, VOCAB).count() == 0
    assert neardup.one_of_each(none).count() == 0 and quality.only_kept(odd, labels).count() <= odd.count()


def test_columns_named_like_the_operators_own_stay(spark):
    """The operators that return the rows of their table keep its columns, whatever these are called."""
    schema = "doc_id long, text string, _id string, _spans string, _blob string, _found string, _near_id string, _near_mark long, _near_n int"
    passage = " ".join(f"p{k}" for k in range(60))
    rows = docs(spark, [(1, f"one {passage}"), (2, f"two {passage} token=zzzzzzzzzzzzzzzz"), (3, "a b c d e"), (4, "A b c d e")], schema)
    rows = rows.withColumns({c: F.lit("7").cast(t) for c, t in rows.dtypes[2:]})
    for out, ids in ((substring.without_repeats(rows), {1, 2, 3, 4}), (secrets.redacted(rows), {1, 2, 3, 4}), (neardup.one_of_each(rows), {1, 3})):
        found = out.collect()
        assert out.columns == rows.columns and {r.doc_id for r in found} >= ids and all(str(x) == "7" for r in found for x in r[2:])


def test_bpe_columns(spark):
    (r,) = bpe.encode_documents(docs(spark, [(1, "hello <|endoftext|> wörld")]), VOCAB).collect()
    assert r.n_tokens == len(r.ids) // 4 and r.decoded_sha256 == hashlib.sha256("hello <|endoftext|> wörld".encode()).hexdigest()
    assert bpe.decode_ids(spark.createDataFrame([(1, r.ids)], "doc_id long, ids binary"), VOCAB).first().text == "hello <|endoftext|> wörld"


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) > 3 else frozenset([tuple(w)] if w else [])
    low = {i: i for i in sets}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    every = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(every):
        for b in every[:k]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies(n, seed=1):
    """Copies of one text with up to a third of its words changed, so that many pairs lie on both sides of the limit."""
    rng = np.random.default_rng(seed)
    base = [f"w{k}" for k in rng.integers(0, 9999, 120)]
    out = []
    for i in range(n):
        own = list(base)
        for _ in range(int(rng.integers(0, 9))):
            own[int(rng.integers(0, 120))] = f"x{rng.integers(0, 99999)}"
        out.append((i * 3, " ".join(own)))
    return out + [(9001, None), (9002, ""), (9003, "one two"), (9004, "ONE  two"), (9005, " ".join(base)), (9006, " ".join(base).upper())]


@pytest.mark.parametrize("rows_a_block", [4096, 17])
def test_near_duplicates_against_brute_force(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_a_block)
    rows = near_copies(250)
    wanted = brute_near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows)).collect()}
    assert got == wanted and len({c for _, c in wanted.values()}) > 20
    kept = neardup.one_of_each(docs(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {c for _, c in wanted.values()}


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    rng = np.random.default_rng(4)
    a, b, c = ([f"q{x}" for x in rng.integers(0, 99_999, 200)] for _ in range(3))
    edit = lambda x: " ".join([*x[:-1], "end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, edit(a)), (3, edit(b)), (4, " ".join(c)), (4, " ".join(c)), (7, edit(c)), (7, None), (None, " ".join(c))]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in neardup.near_duplicates(docs(spark, rows)).collect())
    assert got == sorted([(5, 2, False), (5, 2, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (7, 4, False), (7, 7, True), (0, 0, True)])
    kept = [(r.doc_id, r.text) for r in neardup.one_of_each(docs(spark, rows)).collect()]
    assert sorted(kept, key=str) == sorted([(2, edit(a)), (3, edit(b)), (4, " ".join(c)), (7, None), (None, " ".join(c))], key=str)


def test_near_duplicates_of_real_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df).collect()} == brute_near(rows)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(80)]
    low = {}

    def root(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        low[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}


def exact_repeats(rows):
    seen, out = {}, collections.defaultdict(set)
    for i, t in sorted(rows):
        w = (t or "").encode().split()
        for k in range(len(w) - 49):
            if (key := tuple(w[k : k + 50])) in seen:
                out[i].update(range(k, k + 50))
            else:
                seen[key] = (i, k)
    return out


def covered(df):
    out = collections.defaultdict(set)
    for r in df.filter("not kept").collect():
        out[r.doc_id].update(range(r.start_word, r.end_word))
    return out


def test_repeats_against_brute_force(spark, sf_dir):
    rng = np.random.default_rng(8)
    word = lambda: f"v{rng.integers(0, 1 << 40)}"
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 35)]
    rows = []
    for i in range(60):
        parts = [[word() for _ in range(int(rng.integers(0, 40)))] for _ in range(3)]
        a, b = rng.integers(0, 6, 2)
        # passages that share a part of 35 words, which is no repeat by itself
        own = shared[b] if b < 5 else [*shared[5], *[f"p{i % 7}q{k}" for k in range(25)]]
        rows.append((i, " ".join([*parts[0], *shared[a], *parts[1], *own, *parts[2]])))
    rows += [(100, " ".join(f"z{k % 60}" for k in range(200)))]  # repeats itself
    df = docs(spark, rows)
    wanted, got = exact_repeats(rows), covered(substring.repeated_passages(df))
    assert {i: s - got[i] for i, s in wanted.items() if s - got[i]} == {}
    cut = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    assert not exact_repeats(cut.items())[1] and cut[0] == rows[0][1]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted, got = exact_repeats([(r.doc_id, r.text) for r in real.collect()]), covered(substring.repeated_passages(real))
    assert {i for i, s in wanted.items() if s - got[i]} == set()


def test_nested_passages_against_brute_force(spark):
    """The earliest document holds a part of a passage, later ones all of it."""
    rng = np.random.default_rng(12)
    word = lambda: f"n{rng.integers(0, 1 << 40)}"
    rows = []
    for i in range(60):
        whole = [word() for _ in range(70 + 30 * (i % 2))]
        cut = (5, 10, 15)[i % 3]
        for k, part in enumerate((whole[cut:] if i % 4 < 2 else whole[:-cut], whole, whole)):
            rows.append((k * 100 + i, " ".join([*[word() for _ in range(30)], *part, *[word() for _ in range(30)]])))
    wanted, got = exact_repeats(rows), covered(substring.repeated_passages(docs(spark, rows)))
    assert {i: s - got[i] for i, s in wanted.items() if s - got[i]} == {}


def test_a_passage_with_an_edit_is_found(spark):
    words = [f"e{k * k}" for k in range(120)]
    edited = [*words[:60], "changed", *words[61:]]
    found = covered(substring.repeated_passages(docs(spark, [(1, " ".join(words)), (2, " ".join(edited))])))
    assert found[2] == set(range(120)) and not found[1]


def test_short_passages_with_edits_are_found(spark):
    """50 to 110 words in unrelated contexts, with edits near the middle and a Jaccard similarity of 0.8 or more."""
    rng = np.random.default_rng(13)
    word = lambda: f"m{rng.integers(0, 1 << 40)}"
    shingles = lambda x: {tuple(x[k : k + 5]) for k in range(len(x) - 4)}
    rows, where = [], {}
    for i in range(200):
        size, places = [(52, [26]), (56, [28]), (64, [31]), (76, [38]), (110, [36, 72])][i % 5]
        old = [word() for _ in range(size)]
        new = [x for k, w in enumerate(old) for x in ([w] if k not in places else [[word()], [], [word(), w]][i // 5 % 3])]
        assert (j := len(shingles(old) & shingles(new))) >= 0.8 * (len(shingles(old)) + len(shingles(new)) - j)
        rows += [(i, " ".join([*[word() for _ in range(40)], *old, *[word() for _ in range(40)]])), (1000 + i, " ".join([*[word() for _ in range(50)], *new, *[word() for _ in range(30)]]))]
        where[1000 + i] = set(range(50, 50 + len(new)))
    got = covered(substring.repeated_passages(docs(spark, rows)))
    assert sum(got[i] == s for i, s in where.items()) >= 0.95 * len(where) and all(got[i] <= s for i, s in where.items())


def test_whole_passages_with_edits_and_nothing_else(spark):
    """200 words with two to four edits and a Jaccard similarity of 0.8 or more are found from end to end; unrelated
    words are not."""
    rng = np.random.default_rng(21)
    word = lambda: f"k{rng.integers(0, 1 << 40)}"
    rows, where = [], {}
    for i in range(100):
        old = [word() for _ in range(200)]
        new = list(old)
        for at in rng.choice(np.arange(12, 188), int(rng.integers(2, 5)), replace=False):
            new[at] = word()
        rows += [(i, " ".join([*[word() for _ in range(60)], *old])), (1000 + i, " ".join([*[word() for _ in range(30)], *new, *[word() for _ in range(80)]]))]
        where[1000 + i] = set(range(30, 230))
    got = covered(substring.repeated_passages(docs(spark, rows)))
    assert sum(got[i] == s for i, s in where.items()) >= 0.95 * len(where)
    assert all(got[i] <= s for i, s in where.items()) and set(got) <= set(where)


def test_exact_repeats_are_all_and_only_those(spark, monkeypatch):
    """Passages that many texts share, hot ones, whole copies, and parts of 20 to 49 words that are no repeat."""
    monkeypatch.setattr(substring, "slices", lambda part, column: (part.slice(k, 7) for k in range(0, part.num_rows, 7)))
    rng = np.random.default_rng(22)
    word = lambda: f"h{rng.integers(0, 1 << 40)}"
    some = lambda n: [word() for _ in range(n)]
    hot, shared = some(120), [some(n) for n in (20, 30, 49, 50, 55, 80, 200)]
    rows = []
    for i in range(150):
        parts = [some(int(rng.integers(20, 50)))]
        for k in rng.choice(len(shared), 2, replace=False):
            parts += [shared[k], some(int(rng.integers(20, 50)))]
        if i % 3 == 0:
            a = int(rng.integers(0, 60))
            parts += [hot[a : a + int(rng.integers(50, 70))], some(30)]
        rows.append((i, " ".join(x for p in parts for x in p)))
    rows += [(500 + i, rows[i % 5][1]) for i in range(40)]
    found = substring.repeated_passages(docs(spark, rows))
    wanted = exact_repeats(rows)
    assert covered(found) == wanted
    for r in found.collect():
        assert (r.source_id, r.source_word) <= (r.doc_id, r.start_word) and r.kept == ((r.source_id, r.source_word) == (r.doc_id, r.start_word))


def test_long_texts_keep_their_places():
    words = np.arange(1 << 10, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    left, c, right = substring.compact_windows(np.resize(words, 17_000_000), 1 << 11)
    assert (c[1:] > c[:-1]).all() and c[-1] > 1 << 24 and ((left <= c) & (c <= right)).all()


@pytest.mark.parametrize("small", [200_000, 0])
def test_scan_uses_the_ledger(spark, monkeypatch, small):
    monkeypatch.setattr(secrets, "SMALL", small)
    rows = docs(spark, [(1, "token=zzzzzzzzzzzzzzzz"), (2, "token=zzzzzzzzzzzzzzzz"), (3, "clean"), (None, "AKIA" + "B" * 16)])
    ledger, scanned, rows_scanned = secrets.Ledger(spark), [], []
    real = secrets.scan_blobs

    def watched(texts, rules):
        own = texts.collect()
        scanned.append({x.blob for x in own})
        rows_scanned.append(len(own))
        return real(texts, rules)

    monkeypatch.setattr(secrets, "scan_blobs", watched)
    first = {r.doc_id: len(r.findings) for r in secrets.scan(rows, ledger=ledger).collect()}
    assert first == {1: 1, 2: 1, 3: 0, None: 1} and len(scanned[-1]) == rows_scanned[-1] == 3  # a blob of two paths is scanned once, also by the first scan
    more = docs(spark, [(1, "token=zzzzzzzzzzzzzzzz"), (2, "token=yyyyyyyyyyyyyyyy"), (3, "clean"), (4, "new secret: 0123456789abcdef0")])
    assert {r.doc_id: len(r.findings) for r in secrets.scan(more, ledger=ledger).collect()} == {1: 1, 2: 1, 3: 0, 4: 2} and len(scanned[-1]) == 2
    # both versions of the second path, and the path that is gone
    versions = collections.Counter(r.path for r in secrets.history(ledger).collect() if r.findings)
    assert versions == {"1": 1, "2": 2, "4": 1, None: 1}
    secrets.scan(more, ledger=ledger, rules=secrets.RULES[:1]).collect()
    assert len(scanned[-1]) == 4  # another rule version
    assert [r.text for r in secrets.redacted(more, ledger=ledger).orderBy("doc_id").collect()] == [r.text for r in secrets.redacted(more).orderBy("doc_id").collect()]
    assert secrets.redacted(rows.filter("doc_id = 1")).first().text == "[assign]"
    assert secrets.scan(more, ledger=ledger).count() == 4 and not scanned[-1] - {r.blob for r in secrets.scan(more).collect()}


PATTERNS = {"assign": (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), "access": (r"AKIA[A-Z0-9]+", 0, 18), "hex": (r"[0-9a-f]+", 0, 16)}


def plain_secrets(text):
    found = sorted((m.start(), n, k, m.end()) for n, (k, (p, g, least)) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if len(m[g]) >= least)
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
    return *(sum(x[2] == k for x in found) for k in PATTERNS), hashlib.sha256(joined.encode()).hexdigest()


def test_contract_columns_against_plain_python(spark, sf_dir):
    """The fixed columns of op2, op4, op6, op8 and op10 over a whole table."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    theirs = Tokenizer.from_file(VOCAB)
    ids = {i: np.array(theirs.encode(t, add_special_tokens=False).ids, dtype="<u4") for i, t in texts.items()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    run = lambda name: queries.QUERIES[name](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run("op2_bpe")} == {i: (len(x), sha(x.tobytes()), sha(theirs.decode(x.tolist(), skip_special_tokens=False).encode())) for i, x in ids.items()}
    full = {i: (raw := t.encode()) + b"\0" * (-len(raw) % 64 if raw else 64) for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in run("op4_audio")} == {i: (len(texts[i].encode()), len(x), sha(x), zlib.crc32(x[-64:])) for i, x in full.items()}
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in run("op6_secrets")} == {i: plain_secrets(t) for i, t in texts.items()}
    plain = {}
    for i, t in texts.items():
        own = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = collections.Counter(tuple(own[k : k + 3]) for k in range(len(own) - 2))
        twice = {k + j for k in range(len(own) - 2) if grams[tuple(own[k : k + 3])] > 1 for j in range(3)}
        plain[i] = (len(own), sum(map(len, own)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice), len(own) < 50 or 100 * len(twice) > 50 * len(own))
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in run("op8_quality")} == plain
    pieces = collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in run("op10_packing"))
    own = {i: np.append(x, 0).astype("<u4") for i, x in ids.items()}
    assert pieces == collections.Counter((i, k, s, n, zlib.crc32(x[s : s + n].tobytes())) for i, x in own.items() for k, (s, n) in enumerate(packing.cut(len(x))))


def test_packing_splits_rows_with_one_id(spark):
    rows = packing.pack(docs(spark, [(None, f"word {k % 7}") for k in range(300)]), VOCAB, block=20).collect()
    sizes = collections.Counter(r.sequence_id >> 32 for r in rows)
    assert len(rows) == 300 and len(sizes) >= 14 and max(sizes.values()) < 45


def test_quality_scores_against_plain_counts(spark):
    rng = np.random.default_rng(5)
    texts = {i: " ".join(f"w{x}" for x in rng.zipf(1.5, 80) % (50 if i % 2 else 500)) for i in range(60)}
    labels = [(i, int(i % 2)) for i in range(60)]
    df, marks = docs(spark, list(texts.items())), spark.createDataFrame(labels, "doc_id long, quality int")
    sample = quality.sampled_labels(marks, "doc_id", "quality")
    assert sorted(sample) == labels
    words = quality.WordHashes()
    grams = {i: quality.buckets(words.of(t.encode().split())).tolist() for i, t in texts.items()}
    raw = collections.Counter(g for own in grams.values() for g in own)
    target = collections.Counter(g for i, good in sample[::2] if good for g in grams[i])
    n, a = quality.BUCKETS, quality.ALPHA
    p_raw = lambda g: (raw[g] + a) / (sum(raw.values()) + a * n)
    p_target = lambda g: (target[g] + a * n * p_raw(g)) / (sum(target.values()) + a * n)
    score = {i: sum(np.log(p_target(g) / p_raw(g)) for g in own) / len(own) for i, own in grams.items()}
    got = {r.doc_id: r for r in quality.judge(df, marks).collect()}
    assert all(abs(got[i].score - s) < 1e-4 for i, s in score.items())
    held = [(got[i].score, good) for i, good in sample[1::2]]
    limit = quality.fit_threshold([s for s, _ in held], [g for _, g in held])
    assert {i: r.kept for i, r in got.items()} == {i: r.score >= limit and not r.base_failed for i, r in got.items()}


def test_quality_keeps_good_and_drops_junk(spark, sf_dir):
    df, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.judge(df, labels).collect()}
    known = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].n_words >= 50]
    good, bad = [g for q, g in known if q], [g for q, g in known if not q]
    # two hundred target texts say little about rare words, so only part of the junk falls below every good text
    assert sum(not g.kept and not g.base_failed for g in good) <= 0.01 * len(good) and sum(b.kept for b in bad) <= 0.5 * len(bad)
    kept = {r.doc_id for r in quality.only_kept(df, labels).select("doc_id").collect()}
    assert kept == {i for i, g in got.items() if g.kept}


def test_url_rules_and_reputation(spark):
    urls_ = ["http://a.com/x", "https://EN.example.com/en/1", "http://www.example.com/en/?q", "http://b.net/es/", "http://b.net", "nope", None, "http://com", "x://Bad.org/1", "x://bad.org#f"]
    rows = [(i, u) for i, u in enumerate(urls_)] + [(100 + k, "x://bad.org/p") for k in range(40)] + [(200 + k, f"x://h{k}.example.org/") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, 0 if i < 200 else 1) for i, _ in rows if i >= 100], "page_id long, good int")
    got = {r.page_id: r for r in urls.judge(pages, outcomes).collect()}
    assert [got[i].rule for i in range(8)] == ["com/", "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None]
    assert [got[i].verdict for i in range(10)] == ["allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "block"]
    assert (got[1].host, got[1].path, got[4].path, got[5].host) == ("en.example.com", "/en/1", "", "") and got[200].verdict == "allow"


def test_a_host_without_labels_inherits_from_its_domain(spark):
    rows = [(k, f"x://h{k % 8}.bad.org/p") for k in range(400)] + [(1000 + k, f"x://h{k % 8}.good.org/p") for k in range(400)] + [(2000, "x://new.bad.org/p"), (2001, "x://new.good.org/p")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows if i < 2000], "page_id long, good int")
    df = urls.judge(pages, outcomes)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") < 20
    got = {r.page_id: r for r in df.collect()}
    assert [(got[i].host_labels, got[i].verdict) for i in (2000, 2001)] == [(0, "block"), (0, "allow")]


def test_unlabelled_hosts_and_country_suffixes_equal_the_sql(spark, tmp_path):
    rows = [(k, f"x://h{k % 8}.bad.org/p") for k in range(400)] + [(1000 + k, f"x://h{k % 8}.good.co.uk/p") for k in range(400)] + [(1500 + k, f"x://h{k % 8}.ill.co.uk/p") for k in range(400)]
    rows += [(2000, "x://new.bad.org/p"), (2001, "x://new.good.co.uk/p"), (2002, "x://new.ill.co.uk/p"), (2003, "x://co.uk"), (2004, None), (2005, "x://else.net/")]
    spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'' AS html").write.parquet(f"file://{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, int(1000 <= i < 1500), 0) for i, _ in rows if i < 2000], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    wanted = sorted(con.execute(queries.ORACLE_SQL["op5_url_filter"]).fetchall())
    got = sorted(tuple(r) for r in queries.op5_url_filter(spark, f"file://{tmp_path}").collect())
    assert got == wanted and [r[4] for r in got if r[0] >= 2000] == ["block", "allow", "block", "allow", "allow", "block"]


def test_warc_round_trip(spark):
    big = "é" * 60
    rows = [(3, "u3", big), (1, "u1", big), (2, None, "short"), (4, "u4", "short"), (5, "u5", None), (None, "u6", big), (1, "u1", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(pages, warc.archive_folder(spark), zip64=True), with_payload=True).collect()
    found = collections.Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload is None) for r in got)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert found == collections.Counter(
        [(i, "revisit", 1, 120, digest(big), True) for i in (3, None)] + [(1, "response", None, 120, digest(big), False)] * 2
        + [(i, "response", None, 5, digest("short"), False) for i in (2, 4)] + [(5, "response", None, 0, digest(""), False)]
    )
    by_id = {r.page_id: r for r in got}
    assert by_id[3].refers_to == 1 and by_id[None].refers_to == 1 and by_id[1].record_type == "response" and by_id[2].payload == b"short" and by_id[5].payload_bytes == 0


def test_audio_columns(spark):
    rows = {r.doc_id: r for r in audio.audio_features(docs(spark, [(1, "hé" * 500), (2, None), (3, "hé" * 500)])).collect()}
    a = rows[1]
    payload = ("hé" * 500).encode()
    payload += b"\0" * (-len(payload) % 64)
    assert (a.n_bytes, a.payload_bytes, a.payload_sha256) == (1500, len(payload), hashlib.sha256(payload).hexdigest())
    assert audio.from_wav(bytes(a.media))[1] == payload and a.media_bytes == len(a.media) and a.feature == rows[3].feature
    assert (rows[2].n_bytes, rows[2].payload_bytes, rows[2].tail_crc32, a.tail_crc32) == (0, 64, zlib.crc32(b"\0" * 64), zlib.crc32(payload[-64:]))
    spans, patches, _ = audio.analysed(payload, audio.RATE)
    assert [(x.start_ms, x.end_ms) for x in a.spans] == spans and np.array_equal(np.array(a.patches, np.float32), patches.reshape(len(patches), -1))
    assert rows[2].patches == [] and hashlib.sha256(a.media).hexdigest() == a.media_sha256


def test_templates_are_counted_per_host(spark):
    def page(k, host):
        return (k, f"http://{host}/{k}", f"<body><div><span>Top story list</span></div><p>Text number {k}.</p></body>")

    pages = spark.createDataFrame([page(k, "a.com") for k in range(8)] + [page(9, "b.com")] + [(20 + k, "http://c.com/", "<article><p>Same text.</p></article>") for k in range(9)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    assert got[3] == "Text number 3." and got[9] == "Top story list Text number 9." and got[22] == "Same text."


def test_templates_inside_articles(spark):
    """A notice of every article goes; a passage that a third shares stays, as do articles that are served often."""

    def page(k, host, boxed):
        shared = "<p>A passage that many share.</p>" if k % 3 == 0 else ""
        return (k, f"http://{host}/{k}", f"<body><i>{k}</i><article><p>Words of {k // 2}.</p>{shared}{'<p>Read our <b>terms</b>.</p>' if boxed else ''}</article></body>")

    rows = [page(k, "a.com", True) for k in range(60)] + [page(100 + k, "b.com", k < 20) for k in range(60)] + [(300 + k, "http://c.com/", f"<i>{k}</i><article><p>One text.</p></article>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    shared = lambda k: " A passage that many share." if k % 3 == 0 else ""
    for k in range(60):
        assert got[k] == f"Words of {k // 2}.{shared(k)}"
        assert got[100 + k] == f"Words of {(100 + k) // 2}.{shared(100 + k)}{' Read our terms.' if k < 20 else ''}"
    assert {got[300 + k] for k in range(40)} == {"One text."}
    none = {r.page_id: r.text for r in html.extract(pages, share=2.0).collect()}
    assert none[0].endswith("terms.")


def test_templates_go_on_hosts_of_every_size(spark):
    for size in (20, 7000):
        box = F.when(F.col("id") < 6, "<div><span>Seasonal opening hours</span></div>").otherwise("")
        page = F.concat(F.lit("<body>"), box, F.lit("<div><p>Text number "), F.col("id").cast("string"), F.lit(".</p></div></body>"))
        pages = spark.range(size).select(F.col("id").alias("page_id"), F.lit("http://a.com/").alias("url"), page.alias("html"))
        assert {r.text for r in html.extract(pages).filter("page_id < 6").collect()} == {f"Text number {k}." for k in range(6)}


def test_packing_covers_every_id(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(df, VOCAB, block=50).collect()
    lengths = {r.doc_id: r.n_tokens + 1 for r in bpe.encode_documents(df, VOCAB).collect()}
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert {i: sum(p[2] for p in ps) for i, ps in by_doc.items()} == lengths
    assert all([(k, s, n) for k, (s, n) in enumerate(packing.cut(lengths[i]))] == sorted(ps) for i, ps in by_doc.items())
    for own in by_seq.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by_seq) <= 1.05 * sum(lengths.values()) / 2048 + 4


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == sorted(str([v for _, v in sorted(zip(names, r, strict=True))]) for r in found.fetchall())


def shared_windows(texts, size=50):
    """Windows of `size` words that occur at two places."""
    seen = collections.Counter(tuple(w[k : k + size]) for w in (t.split() for t in texts) for k in range(len(w) - size + 1))
    return sum(n > 1 for n in seen.values())


def test_pipeline_stage_by_stage(spark, sf_dir):
    """Each stage on what its predecessor kept, against plain Python, and all together as run() has it."""
    start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now, texts = start, {r.doc_id: r.text for r in start.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stored(stage(spark, now, sf_dir), name)
        got = {r.doc_id: r.text for r in after.collect()}
        assert after.columns == start.columns and set(got) <= set(texts)
        if name == "quality_rules":
            assert got == {i: t for i, t in texts.items() if i in {r.doc_id for r in quality.judge(now, labels).filter("kept").collect()}} and len(got) < len(texts)
            assert not any(len((t or "").split()) < 50 for t in got.values())
        elif name == "near_dedup":
            groups = brute_near(sorted(texts.items()))
            assert got == {i: texts[i] for i, (_, c) in groups.items() if i == c}
        elif name == "substring_dedup":
            assert set(got) == set(texts) and shared_windows(texts.values()) > 0 == shared_windows(got.values())
        else:
            assert set(got) == set(texts) and all(len(plain_secrets(t)) and plain_secrets(t)[:3] == (0, 0, 0) for t in got.values())
            assert {i for i in got if got[i] != texts[i]} >= {i for i, t in texts.items() if any(plain_secrets(t)[:3])}
        now, texts = after, got
    own = Tokenizer.from_file(VOCAB)
    want = collections.Counter()
    for i, text in texts.items():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, (at, n) in enumerate(packing.cut(len(ids))):
            want[i, piece, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    rows = out.collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for own in held.values():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) <= packing.LENGTH


def test_pipeline_takes_odd_and_empty_tables(spark, tmp_path, odd):
    spark.createDataFrame([(5, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    more = odd.withColumns({"n_chars": F.length("text"), "_id": F.lit("x"), "_blob": F.lit("x"), "_near_id": F.lit("x")})
    blank = docs(spark, [(20, "word " * 60 + " " * 1_200_000 + "end")]).select(*[F.col(c) if c in ("doc_id", "text") else F.lit(None).cast(t).alias(c) for c, t in more.dtypes])
    more.unionByName(blank).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert 4 in kept and not kept & {1, 2, 3}
    empty = tmp_path / "empty"
    more.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
