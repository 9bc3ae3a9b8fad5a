"""Substring dedup by compact windows.

A text is its sequence of word 5-shingles. Under a hash function the subsequences of at least T shingles fall into
compact windows (l, c, r): all that start in [l, c] and end in [c, r] have their min-hash at c. They are the nodes of
width T or more of the Cartesian tree over the hashes; a sliding minimum finds these nodes, a stack over them alone the
bounds. Two occurrences of a passage share a window's min-hash and, unless edits are on both sides of it, KEY words that
start or end with that shingle. Windows are grouped by these words; each slice of a task links its own windows of a key
to the first of them and sends that one alone, so that a hot key is a row per slice, and the first ones meet by key.

Each window is thus linked to the first occurrence of its key. Per pair of texts the intervals of all hash functions are
collected: where one overlaps its partner's in a passage's length, the pair is verified by extending the equal words
around the anchors and, past gaps of up to GAP words, from one equal run to the next; the longest row of such runs whose
5-shingles have a Jaccard similarity of 0.8 is a near-duplicate passage. Texts that equal their first occurrence as a whole
are one span and are not compared further.

Two members can share more than their first occurrence has: their equal runs with it then end at the same place, before
the same word. There the members are compared once more, by all windows of WORDS words and by AGAIN words across that
place; both only anchor pairs, whose words are then compared. So every repeated run of WORDS words is found; with edits, what HASHES functions find.

A passage counts as repeated where an earlier (id, position) holds it. Null text counts as empty; texts under WORDS
words have no passage. Null ids take no part. Rows that repeat with id and text count once; an id with several texts
gets the spans of each. Extra columns stay out of the result. Texts may have up to 2**51 words.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.operators.ingest import free_name

from .common import hashed_words, mix64, shingle_hashes, slices, stored, utf8

SHINGLE, WORDS, HASHES = 5, 50, 2
#: The least width of a window in shingles.
LEAST = WORDS - SHINGLE + 1
#: Words of a window's key, and of the keys across a place where members go on alike.
KEY, AGAIN = 15, 20
#: Equal runs of a pair join over at most so many words on either side, while the similarity is at least SIMILARITY.
GAP, SIMILARITY = 8, 0.8
#: Words of the texts whose windows are sought together.
GROUP = 1 << 15
#: Bits of a window's sides, each cut at LEAST, below its centre.
SIDE = 6
#: Stand in place of a span's end in the rows of runs' ends.
LEFT, RIGHT = -1, -2
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def compact_windows(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least `least` positions, by c. Of equal hashes the leftmost is smaller."""
    n = len(hashes)
    if n < least:
        return (np.empty(0, dtype=np.int64),) * 3
    mask = np.uint64((1 << max(20, n.bit_length())) - 1)
    keys = (hashes & ~mask) | (np.arange(n, dtype=np.uint64) & mask)
    blocks = np.full(-(-n // least) * least, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, least)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    lows = np.minimum(behind[: n - least + 1], ahead[least - 1 : n])
    lows = lows[np.concatenate([[True], lows[1:] != lows[:-1]])]
    centres = (lows & mask).astype(np.int64)
    left, right = bounds_of(lows.tolist(), centres.tolist(), 0, n - 1)
    return np.array(left, dtype=np.int64), centres, np.array(right, dtype=np.int64)


def bounds_of(values: list[int], places: list[int], first: int, last: int) -> tuple[list[int], list[int]]:
    """How far each value, at its place from first to last, is the smallest."""
    left, right = [first] * len(values), [last] * len(values)
    stack: list[int] = []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = places[k] - 1
        if stack:
            left[k] = places[stack[-1]] + 1
        stack.append(k)
    return left, right


def compact_windows_of(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """compact_windows() of several stretches of hashes at once, each of at least `least` and all of under 2**20 positions:
    stretch, l, c, r, places within the stretch."""
    mask = np.uint64((1 << 20) - 1)
    padded = -(-sizes // least) * least  # no block holds two stretches
    base = np.cumsum(padded) - padded
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    blocks = np.full(int(padded.sum()), np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[inner + np.repeat(base, sizes)] = (hashes[inner + np.repeat(starts, sizes)] & ~mask) | inner.astype(np.uint64)
    blocks = blocks.reshape(-1, least)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = sizes - least + 1
    at = np.arange(int(counts.sum())) + np.repeat(base - np.cumsum(counts) + counts, counts)
    lows = np.minimum(behind[at], ahead[at + least - 1])
    owner = np.repeat(np.arange(len(sizes)), counts)
    new = np.concatenate([[True], (lows[1:] != lows[:-1]) | (owner[1:] != owner[:-1])])
    lows, owner = lows[new], owner[new]
    centres = (lows & mask).astype(np.int64)
    values, places, left, right = lows.tolist(), centres.tolist(), [], []
    ends = np.searchsorted(owner, np.arange(len(sizes)), side="right").tolist()
    for start, end, size in zip([0, *ends[:-1]], ends, sizes.tolist(), strict=True):
        l, r = bounds_of(values[start:end], places[start:end], 0, size - 1)
        left += l
        right += r
    return owner, np.array(left, dtype=np.int64), centres, np.array(right, dtype=np.int64)


def long_hashes(short: np.ndarray, size: int, starts: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `size` words, a multiple of SHINGLE, at the starts, from those of SHINGLE words."""
    out = short[starts]
    for k in range(SHINGLE, size, SHINGLE):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += short[starts + k]
        out ^= out >> np.uint64(31)
    return mix64(out, 5)


class Keyed:
    """Collects (key, id, at) of a slice; batch() has them with each key's first one alone, the others as its members."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.ids: list[np.ndarray] = []
        self.at: list[np.ndarray] = []

    def add(self, keys: np.ndarray, i: int | np.ndarray, at: np.ndarray) -> None:
        self.keys.append(keys)
        self.ids.append(i if isinstance(i, np.ndarray) else np.full(len(keys), i, dtype=np.int64))
        self.at.append(at.astype(np.int64))

    def batch(self) -> pa.RecordBatch:
        none = [np.empty(0, np.int64)]
        key, ids, at = (np.concatenate(x or none) for x in ([k.view(np.int64) for k in self.keys], self.ids, self.at))
        order = np.argsort(key, kind="stable")
        key, ids, at = key[order], ids[order], at[order]
        again = key[1:] == key[:-1]
        shared = np.flatnonzero(np.concatenate([again, [False]]) | np.concatenate([[False], again])) if len(key) else np.empty(0, np.int64)
        if len(shared):  # few keys occur twice in a slice
            inner = shared[np.lexsort((at[shared], ids[shared], key[shared]))]
            ids[shared], at[shared] = ids[inner], at[inner]
        first = np.ones(len(key), dtype=bool)
        first[1:] = ~again
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        new = first | (ids != ids[lead]) | (at != at[lead])
        cols = {"key": key[new], "id": ids[new], "at": at[new]} | {name: pa.array(x[lead][new], mask=first[new]) for name, x in (("to_id", ids), ("to_at", at))}
        return pa.record_batch({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in cols.items()})


KEYED = "key long, id long, at long, to_id long, to_at long"


def together(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """The texts with a passage's length in groups of about GROUP words; a longer text is a group of its own."""
    long_enough = np.flatnonzero(sizes >= WORDS)
    held = np.cumsum(sizes[long_enough])
    at = 0
    while at < len(long_enough):
        before = held[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(held, before + GROUP, side="right")))
        yield long_enough[at:end]
        at = end


def add_windows(found: Keyed, ids: np.ndarray, texts: list[np.ndarray], sizes: np.ndarray) -> None:
    """Both keys of all compact windows of the texts: arrays of several texts cost few calls, and fit the cache."""
    words = np.concatenate(texts) if len(texts) > 1 else texts[0]
    starts = np.cumsum(sizes) - sizes
    short = shingle_hashes(words, SHINGLE)  # those across two texts are not used
    for f in range(HASHES):
        hashes = mix64(short, 100 + f)
        if len(texts) > 1:
            owner, left, c, right = compact_windows_of(hashes, starts, sizes - SHINGLE + 1, LEAST)
        else:
            left, c, right = compact_windows(hashes, LEAST)
            owner = np.zeros(len(c), dtype=np.int64)
        packed = (c << (2 * SIDE)) | (np.minimum(c - left, LEAST) << SIDE) | np.minimum(right - c, LEAST)
        for side, start in ((0, c), (1, c + SHINGLE - KEY)):
            fits = (start >= 0) & (start <= sizes[owner] - KEY)
            found.add(mix64(long_hashes(short, KEY, (starts[owner] + start)[fits]), 2 * f + side), ids[owner[fits]], packed[fits])


def windows(df: DataFrame) -> DataFrame:
    """(id, text) to KEYED rows: two keys per compact window and hash function; at packs c, c - l and r - c."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = Keyed()
                own = hashed_words(utf8(part.column("text")))
                sizes = np.array([len(w) for w in own], dtype=np.int64)
                ids = np.asarray(part.column("id").to_numpy(zero_copy_only=False), dtype=np.int64)
                for group in together(sizes):
                    add_windows(found, ids[group], [own[k] for k in group.tolist()], sizes[group])
                yield found.batch()

    return df.mapInArrow(work, KEYED)


def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """KEYED rows sorted by key, id, at: the first ones of the slices with the first of all; members pass as they are."""
    lead: tuple[int, int, int] | None = None
    for batch in batches:
        member = batch.column("to_id").is_valid().to_numpy(zero_copy_only=False)
        if member.any():
            yield batch.filter(pa.array(member)).append_column("member", pa.array(np.ones(int(member.sum()), dtype=bool)))
        key, ids, at = (batch.column(k).to_numpy()[~member] for k in ("key", "id", "at"))
        if not len(key):
            continue
        start = np.concatenate([[lead is None or key[0] != lead[0]], key[1:] != key[:-1]])
        heads = np.flatnonzero(start)
        head_id, head_at = ids[heads], at[heads]
        if not start[0]:
            head_id, head_at = np.concatenate([[lead[1]], head_id]), np.concatenate([[lead[2]], head_at])
        group = np.cumsum(start) - (1 if start[0] else 0)
        to_id, to_at = head_id[group], head_at[group]
        lead = (key[-1], to_id[-1], to_at[-1])
        other = (ids != to_id) | (at != to_at)
        if other.any():
            cols = [pa.array(x[other]) for x in (key, ids, at, to_id, to_at)]
            yield pa.record_batch([*cols, pa.array(np.zeros(int(other.sum()), dtype=bool))], names=["key", "id", "at", "to_id", "to_at", "member"])


def links_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KEYED rows to (id, at, to_id, to_at): each with the first of its key; and the stored table that this reads."""
    spread = F.when(F.col("to_id").isNull(), F.col("key")).otherwise(F.xxhash64("key", "to_id", "id"))
    met = stored(rows.repartition(spread).sortWithinPartitions("key", "id", "at").mapInArrow(linked, f"{KEYED}, member boolean"), "windows")
    firsts = met.filter(~F.col("member"))
    whole = firsts.select("key", F.col("id").alias("to_id"), F.col("at").alias("to_at"), F.col("to_id").alias("_id"), F.col("to_at").alias("_at"))
    members = met.filter("member").join(whole, ["key", "to_id", "to_at"], "left").select("id", "at", F.coalesce("_id", "to_id").alias("to_id"), F.coalesce("_at", "to_at").alias("to_at"))
    return firsts.select("id", "at", "to_id", "to_at").unionByName(members), met


def equal_run(a: np.ndarray, b: np.ndarray) -> int:
    """How many first words of a and b are equal; looks only as far as they are."""
    n, most, step = 0, min(len(a), len(b)), 64
    while n < most:
        diff = a[n : min(n + step, most)] != b[n : min(n + step, most)]
        if (k := int(diff.argmax())) or diff[0]:
            return n + k
        n, step = n + step, step * 4
    return most


class Text:
    """A text's words (32 bits of each one's hash) and the hashes of its shingles; before() reads it backwards from a place."""

    def __init__(self, words: np.ndarray, shingles: np.ndarray | None = None):
        self.words = words
        self.shingles = shingle_hashes(words.astype(np.uint64), SHINGLE) if shingles is None else shingles

    def after(self, place: int) -> Text:
        return Text(self.words[place:], self.shingles[place:])

    def before(self, place: int) -> Text:
        return Text(self.words[:place][::-1], self.shingles[: max(0, place - SHINGLE + 1)][::-1])


def blocks_of(a: Text, b: Text, at: np.ndarray, same: bool) -> list[tuple[int, int, int]]:
    """Maximal equal runs (start in a, start in b, length) through the anchors at, the first words of equal shingles."""
    at = at[(at[:, 0] < len(a.shingles)) & (at[:, 1] < len(b.shingles))]
    at = at[a.shingles[at[:, 0]] == b.shingles[at[:, 1]]]  # the others are of another text under the same id
    at = at[np.lexsort((at[:, 0], at[:, 0] - at[:, 1]))]
    out, offset, end = [], None, 0
    for x, y in at.tolist():
        if x - y == offset and x < end:
            continue
        ahead, behind = equal_run(a.words[x:], b.words[y:]), equal_run(a.words[:x][::-1], b.words[:y][::-1])
        offset, end = x - y, x + ahead
        if not same or x > y:
            out.append((x - behind, y - behind, behind + ahead))
    return sorted(out)


def outer(rows: list[tuple[int, ...]], ends) -> list[tuple[int, ...]]:
    """The rows that do not lie, on both sides, within the widest one before them; ends(row): start and end in a and in b."""
    out, widest = [], None
    for row in sorted(rows, key=lambda r: (ends(r)[0], -ends(r)[1])):
        x, end, y, to_end = ends(row)
        if widest and end <= widest[1] and widest[2] <= y and to_end <= widest[3]:
            continue
        if not widest or end > widest[1]:
            widest = (x, end, y, to_end)
        out.append(row)
    return out


def edges(a: np.ndarray, runs_: list[tuple[int, int, int]]) -> np.ndarray:
    """(place in a, LEFT or RIGHT, first place in b, a's next word, last place in b) of the runs' ends within a. Where one
    run holds all WORDS-word windows across such a place, they are repeated anyway, and their earliest occurrence in b has
    an end of its own."""
    if not runs_:
        return np.empty((0, 5), dtype=np.int64)
    x, y, n = np.array(runs_).T
    # all runs are sorted by their start
    reach = np.maximum.accumulate(x + n)
    found = []
    for kind, place, to_place, step in ((LEFT, x, y, -1), (RIGHT, x + n, y + n, 0)):
        last = np.searchsorted(x, np.maximum(place - WORDS + 1, 0), side="right") - 1
        keep = (place > 0) & (place < len(a)) & ((last < 0) | (reach[last] < np.minimum(place + WORDS - 1, len(a))))
        order = np.lexsort((to_place[keep], place[keep]))
        place, to_place = place[keep][order], to_place[keep][order]
        if len(place):
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            end = np.append(first[1:], len(place)) - 1
            at = place[first]
            found.append(np.column_stack([at, np.full(len(at), kind), to_place[first], a[at + step], to_place[end]]))
    return np.concatenate(found or [np.empty((0, 5), dtype=np.int64)])


def next_run(a: Text, b: Text) -> tuple[int, int] | None:
    """The nearest places within GAP words, first in a, where SHINGLE equal words of a and b start."""
    same = a.shingles[: GAP + 1, None] == b.shingles[None, : GAP + 1]
    if not same.any():
        return None
    x, y = np.nonzero(same)
    k = (x + y).argmin()
    return int(x[k]), int(y[k])


def onward(a: Text, b: Text) -> Iterator[tuple[int, int, int]]:
    """The equal runs that follow each other in a and b, each after a gap of up to GAP words."""
    x = y = 0
    while step := next_run(a.after(x), b.after(y)):
        x, y = x + step[0], y + step[1]
        yield x, y, (n := equal_run(a.words[x:], b.words[y:]))
        x, y = x + n, y + n


def passages(a: Text, b: Text, runs_: list[tuple[int, int, int]], same: bool) -> list[tuple[int, int, int, int]]:
    """(start, end, start in b, end in b) of the repeated passages around the equal runs. same: a is b, and a passage's
    runs stand behind their sources."""

    def span(row: list[tuple[int, int, int]]) -> tuple[int, int, int, int]:
        return row[0][0], row[-1][0] + row[-1][2], row[0][1], row[-1][1] + row[-1][2]

    def alike(row: list[tuple[int, int, int]]) -> bool:
        if len(row) == 1:
            return True
        s = span(row)
        x, y = a.shingles[s[0] : s[1] - SHINGLE + 1], b.shingles[s[2] : s[3] - SHINGLE + 1]
        if len(x) + len(y) < 500:  # sets are faster for few shingles, arrays for many
            x, y = set(x.tolist()), set(y.tolist())
            both = len(x & y)
        else:
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= SIMILARITY * (len(x) + len(y) - both)

    def longest(row: list[tuple[int, int, int]]) -> tuple[int, int]:
        """The longest stretch of runs with SIMILARITY, taken by counts: shared - SIMILARITY * union, summed, is positive."""
        x, y, n = np.array(row).T
        own = (1 + SIMILARITY) * np.cumsum(n - SHINGLE + 1)
        low = np.minimum.accumulate(np.concatenate([[0.0], own[:-1]]) - SIMILARITY * (x + y))
        gain = own - SIMILARITY * (x + y + 2 * n - 2 * SHINGLE + 2)
        # the earliest start for each end: low never rises
        start = np.searchsorted(-low, -gain - 1e-9)
        size = np.arange(1, len(row) + 1) - start
        end = int(size.argmax())
        return (int(start[end]), end + 1) if size[end] > 0 else (int(n.argmax()), int(n.argmax()) + 1)

    out: set[tuple[int, int, int, int]] = set()
    done: set[tuple[int, int, int]] = set()
    for run in runs_:
        if run in done:
            continue
        x, y, n = run
        behind = [(x - u - m, y - v - m, m) for u, v, m in onward(a.before(x), b.before(y))]
        ahead = [(x + n + u, y + n + v, m) for u, v, m in onward(a.after(x + n), b.after(y + n))]
        whole = [*behind[::-1], run, *ahead]
        done.update(whole)
        if same and any(u <= v for u, v, _ in whole):
            whole = [r for r in whole if r[0] > r[1]]
        rows = [whole]
        while rows:
            row = rows.pop()
            if not row or min((s := span(row))[1] - s[0], s[3] - s[2]) < WORDS:
                continue
            first, last = (0, len(row)) if alike(row) else longest(row)
            while not alike(row[first:last]):
                first, last = (first + 1, last) if row[first][2] < row[last - 1][2] else (first, last - 1)
            s = span(row[first:last])
            if min(s[1] - s[0], s[3] - s[2]) >= WORDS:
                out.add(s)
            rows += [row[:first], row[last:]]
    return sorted(out)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans sorted by id, kept, start: overlapping ones of an id become one, with the first source. First occurrences
    that lie within a later one go."""
    now, spans = None, []
    out: list[tuple] = []

    def closed() -> Iterator[tuple]:
        later: list[list] = []
        for row in spans:
            if row[1]:
                k = bisect_right(later, row[2], key=lambda x: x[2]) - 1
                if k >= 0 and row[3] <= later[k][3]:
                    continue
            else:
                later.append(row)
            yield tuple(row)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.bool_()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["id", "kept", "start_word", "end_word", "source_id", "source_word"])

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("id", "kept", "start", "end", "to_id", "to_start")), strict=True):
            if row[0] != now:
                out += closed()
                now, spans = row[0], []
            held = spans[-1] if spans else None
            if held and held[1] == row[1] and row[2] <= held[3]:
                held[3] = max(held[3], row[3])
                if (row[4], row[5]) < (held[4], held[5]):
                    held[4:6] = row[4:6]
            else:
                spans.append(list(row))
        if len(out) > 5000:
            yield batch_of(out)
            out = []
    out += closed()
    if out:
        yield batch_of(out)


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to id, digest, n, words (32 bits of each word's hash)."""
    for batch in batches:
        for part in slices(batch, "text"):
            own = hashed_words(utf8(part.column("text")))
            digests = [xxhash.xxh3_128_digest(w.tobytes()) for w in own]
            yield pa.record_batch({"id": part.column("id"), "digest": pa.array(digests, pa.binary()), "n": pa.array(map(len, own), pa.int64()), "words": pa.array([w.astype(np.uint32).tobytes() for w in own], pa.binary())})


SPAN = "id long, to_id long, start long, end long, to_start long, to_end long, to_last long"


def verify(batches: Iterator[pa.RecordBatch], with_ends: bool = True) -> Iterator[pa.RecordBatch]:
    """Pairs with their anchors and words to the repeated passages and, if wanted, to the ends of the equal runs."""
    for batch in batches:
        every, ends, lengths = [], [], []
        anchors = batch.column("anchors")
        at = np.column_stack([anchors.flatten().field(k).to_numpy() for k in ("c", "to_c")])
        bounds = np.concatenate([[0], np.cumsum(anchors.value_lengths().to_numpy())]).tolist()
        cols = [batch.column(k).to_pylist() for k in ("id", "to_id", "near", "words", "to_words")]
        last, b = None, None
        for i, j, near, x, y, start, end in zip(*cols, bounds[:-1], bounds[1:], strict=True):
            if y != last:  # pairs with one first occurrence stand together
                last, b = y, Text(np.frombuffer(y, dtype=np.uint32))
            a = b if x == y else Text(np.frombuffer(x, dtype=np.uint32))
            own = blocks_of(a, b, at[start:end], i == j)
            if near or any(n >= WORDS for _, _, n in own):
                spans = outer(passages(a, b, outer(own, lambda r: (r[0], r[0] + r[2], r[1], r[1] + r[2])), i == j), lambda s: s)
                every += [(i, j, *s) for s in spans]
            ends.append(edges(a.words, own) if with_ends else np.empty((0, 5), dtype=np.int64))
            lengths.append(len(ends[-1]))
        found = np.array(every, dtype=np.int64).reshape(-1, 6)
        places = np.concatenate([np.empty((0, 5), dtype=np.int64), *ends])
        ids, to_ids = (np.concatenate([found[:, k], np.repeat(np.array(cols[k], dtype=np.int64), np.array(lengths, dtype=np.int64))]) for k in (0, 1))
        if len(ids):
            to_last = np.concatenate([np.zeros(len(found), dtype=np.int64), places[:, 4]])
            middle = [np.concatenate([found[:, 2 + k], places[:, k]]) for k in range(4)]
            out = [pa.array(x) for x in (ids, to_ids, *middle)] + [pa.array(to_last, mask=np.arange(len(ids)) < len(found))]
            yield pa.record_batch(out, names=["id", "to_id", "start", "end", "to_start", "to_end", "to_last"])


def verified(anchors: DataFrame, words: DataFrame, with_ends: bool = True) -> DataFrame:
    """anchors (id, c, to_id, to_c, near) per pair, against both texts; SPAN rows, those of runs' ends, if wanted, with a
    negative end."""
    pairs = anchors.groupBy("id", "to_id").agg(F.collect_set(F.struct("c", "to_c")).alias("anchors"), F.max("near").alias("near"))  # at most a text's windows
    both = pairs.join(words.select("id", "words"), "id").join(words.select(F.col("id").alias("to_id"), F.col("words").alias("to_words")), "to_id")
    return both.select("id", "to_id", "anchors", "near", "words", "to_words").mapInArrow(partial(verify, with_ends=with_ends), SPAN)


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, places, words) to KEYED rows: all windows of WORDS words across each place (at is even) and AGAIN words of
    which KEY lie on the side of the run that ends there (at is odd)."""
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part, found = batch.slice(k, 500), Keyed()
            for i, places, x in zip(*(part.column(c).to_pylist() for c in ("id", "places", "words")), strict=True):
                words = np.frombuffer(x, dtype=np.uint32).astype(np.uint64)
                short = shingle_hashes(words, SHINGLE)
                at = np.array([p["start"] for p in places], dtype=np.int64)
                right = np.array([p["end"] for p in places]) == RIGHT
                starts = np.unique((at[:, None] - np.arange(1, WORDS)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(words) - WORDS)]
                found.add(mix64(long_hashes(short, WORDS, starts), 11), i, starts * 2)
                starts = np.unique(np.where(right, at - KEY, at - (AGAIN - KEY)))
                starts = starts[(starts >= 0) & (starts <= len(words) - AGAIN)]
                found.add(mix64(long_hashes(short, AGAIN, starts), 12), i, starts * 2 + 1)
            yield found.batch()


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per repeated span: id, kept (true for the first occurrence), start_word, end_word, source_id, source_word.

    Words are numbered from 0, ends are exclusive. A first occurrence is its own source."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(F.col("id").isNotNull() & F.col("text").isNotNull())
    links, met = links_of(windows(rows))
    side = (1 << SIDE) - 1
    l, r = (F.least(F.shiftright("at", k).bitwiseAND(side), F.shiftright("to_at", k).bitwiseAND(side)) for k in (SIDE, 0))
    anchors = links.select("id", F.shiftright("at", 2 * SIDE).alias("c"), "to_id", F.shiftright("to_at", 2 * SIDE).alias("to_c"), (l + r + 1 >= LEAST).alias("near"))
    anchors = stored(anchors.filter((F.col("id") != F.col("to_id")) | (F.col("c") != F.col("to_c"))).distinct(), "anchors", drop=(met,))
    wanted = anchors.select(F.explode(F.array("id", "to_id")).alias("id")).distinct()
    words = stored(rows.join(wanted, "id", "left_semi").mapInArrow(tokens, "id long, digest binary, n long, words binary").dropDuplicates(["id", "digest"]), "words")

    # texts that equal their first occurrence: one span, no comparison
    single = words.groupBy("id").agg(F.count("*").alias("texts"), F.min("digest").alias("digest"), F.min("n").alias("n")).filter("texts = 1")
    ends = anchors.filter(F.col("id") != F.col("to_id")).select("id", "to_id").distinct()
    equal = ends.join(single.select("id", "digest", "n"), "id").join(single.select(F.col("id").alias("to_id"), F.col("digest").alias("to_digest")), "to_id").filter(F.col("digest") == F.col("to_digest"))
    copies = stored(equal.groupBy("id").agg(F.min("to_id").alias("to_id"), F.min("n").alias("n")), "copies")
    whole = copies.select("id", "to_id", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"), F.lit(0).cast("long").alias("to_start"), F.col("n").alias("to_end"))
    checked = stored(verified(anchors.join(copies.select("id"), "id", "left_anti"), words), "checked")

    # where several members go on alike beyond their first occurrence: ends before the same word, at the same place of it
    # or, for runs of one text that end together, in overlapping stretches of places
    group = Window.partitionBy("to_id", "end", "to_end").orderBy("to_start", "to_last", "id", "start")
    before = F.max("to_last").over(group.rowsBetween(Window.unboundedPreceding, -1))
    met_others = F.coalesce(before >= F.col("to_start"), F.lit(False)) | F.coalesce(F.lead("to_start").over(group) <= F.col("to_last"), F.lit(False))
    places = checked.filter(F.col("end") < 0).withColumn("open", met_others).filter("open").groupBy("id").agg(F.collect_set(F.struct("start", "end")).alias("places"))  # at most a text's words
    more, met = links_of(places.join(words, "id").select("id", "places", "words").mapInArrow(across, KEYED))
    again = more.select("id", F.shiftright("at", 1).alias("c"), "to_id", F.shiftright("to_at", 1).alias("to_c"), F.lit(True).alias("near"))

    spans = checked.filter(F.col("end") >= 0).unionByName(verified(again, words, with_ends=False)).drop("to_last").unionByName(whole)
    spans = stored(spans.distinct(), "spans", drop=(checked, anchors, words, copies, met))
    later = spans.select("id", F.lit(False).alias("kept"), "start", "end", "to_id", "to_start")
    first = spans.select(F.col("to_id").alias("id"), F.lit(True).alias("kept"), F.col("to_start").alias("start"), F.col("to_end").alias("end"), "to_id", "to_start").distinct()
    out = later.unionByName(first).repartition("id").sortWithinPartitions("id", "kept", "start", "end").mapInArrow(merged, "id long, kept boolean, start_word long, end_word long, source_id long, source_word long")
    return out.withColumnRenamed("id", id_col)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the sorted spans; what stood between two kept parts becomes one line break."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw)]
    parts, at = [], 0
    for start, end in spans:
        start, end = min(start, len(places)), min(end, len(places))
        if start > at:
            parts.append(raw[places[at][0] if at else 0 : places[start - 1][1]])
        at = max(at, end)
    if at < len(places):
        parts.append(raw[places[at][0] if at else 0 :])
    return b"\n".join(parts).decode()


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with every later occurrence of a repeated passage cut from its text; other columns and all rows stay."""
    found = repeated_passages(df, id_col, text_col).filter(~F.col("kept"))
    key, spans = free_name("_id", df), free_name("_spans", df)
    lists = found.groupBy(F.col(id_col).cast("long").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias(spans))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            texts = [x if not s or x is None else cut_words(x, [(p["start_word"], p["end_word"]) for p in s]) for x, s in zip(batch.column(k).to_pylist(), batch.column(spans).to_pylist(), strict=True)]
            yield batch.set_column(k, text_col, pa.array(texts, batch.column(k).type)).drop_columns([spans])

    return df.join(lists, F.col(id_col).cast("long") == F.col(key), "left").drop(key).mapInArrow(work, df.schema)
