"""Maximal periodic runs of words, by a suffix automaton whose end-position sets are merged small to large.

A run is a stretch of consecutive words with smallest period q and at least max(LEAST, EXPONENT * q) words that no
neighbouring word extends keeping q. Its parts end at the same state of the automaton as those q words further on. From
the longest states down, the ordered end-position sets of a state's children are merged into the largest of them; where
two ends become neighbours at a state of length m, the words before them agree on exactly m words. If their distance d does
not exceed m, the words from the first end - m + 1 up to the second end are a square of period d or more, which no word to
the left extends. By Fine and Wilf d is the smallest period there, and the run's last such pair reaches the run's end, so
extending a square to the right is taking the farthest end of its (start, d).

Only stretches where every three words in a row occur three times within the stretch are given to the automaton: a run of
four periods (six words if q is 1) lies wholly within one, so none is lost. Runs of fewer periods are not sought.

One narrow stage; a worker holds a slice of texts, and about 0.6 KB for each word of the longest such stretch. Null text
counts as empty and has no runs. Rows that repeat, and null ids, get a row each; extra columns stay out of the result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, utf8

#: A run has so many words and so many periods at least; EXPONENT must be 4 or more, LEAST 6 or more.
LEAST, EXPONENT = 6, 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers, from 0 in order of appearance."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def candidates(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of at least LEAST words whose triples each occur three times in the stretch."""
    n = len(numbers) - 2
    if n < LEAST - 2:
        return []
    most = int(numbers.max()) + 1
    _, pairs = np.unique(numbers[:-1] * most + numbers[1:], return_inverse=True)
    _, triples = np.unique(pairs[:-1].astype(np.int64) * most + numbers[2:], return_inverse=True)
    label, places = np.zeros(n, dtype=np.int64), np.arange(n)  # of the triples that are left: their stretch, their place
    while len(places):
        _, group, counts = np.unique(label * n + triples[places], return_inverse=True, return_counts=True)
        good = counts[group] >= 3
        kept, old = places[good], label[good]
        new = np.cumsum(np.r_[0, (np.diff(kept) > 1) | (np.diff(old) > 0)]) if len(kept) else old
        enough = np.bincount(new)[new] >= LEAST - 2 if len(kept) else good[:0]
        if good.all() and enough.all():
            break
        places, label = kept[enough], new[enough]
    cuts = np.flatnonzero(np.diff(label)) + 1 if len(places) else []
    return [(int(p[0]), int(p[-1]) + 3) for p in np.split(places, cuts) if len(p)]


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Of the suffix automaton: each state's length, suffix link, and the place where it ends as a prefix (-1: none)."""
    step: list[dict[int, int]] = [{}]
    length, link, end = [0], [-1], [-1]
    last = 0
    for i, c in enumerate(words):
        now = len(step)
        step.append({})
        length.append(i + 1)
        link.append(0)
        end.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(step[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                end.append(-1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return length, link, end


def runs_in(words: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a stretch, by start and period."""
    length, link, end = suffix_links(words)
    children: dict[int, list[list[int]]] = {}
    farthest: dict[tuple[int, int], int] = {}
    # the last pair of a run meets at a state of length - q words, so shorter states than these seed none
    shortest = LEAST - LEAST // EXPONENT
    for state in np.argsort(np.array(length), kind="stable")[::-1].tolist():
        size = length[state]
        if size < shortest:
            break
        sets = children.pop(state, [])
        if end[state] >= 0:
            sets.append([-end[state]])  # ends are negative: on periodic words the next one goes to the list's end
        whole = max(sets, key=len)
        if len(sets) > 1:
            added = {e: number for number, own in enumerate(sets) if own is not whole for e in own}
            for e in added:
                insort(whole, e)
            for e in added:
                at = bisect_left(whole, e)
                for k in (at - 1, at):
                    if 0 <= k < len(whole) - 1:
                        d = whole[k + 1] - whole[k]
                        if d * (EXPONENT - 1) <= size and added.get(whole[k]) != added.get(whole[k + 1]):  # new neighbours
                            key = (-whole[k + 1] - size + 1, d)
                            if farthest.get(key, -1) < -whole[k]:
                                farthest[key] = -whole[k]
        children.setdefault(link[state], []).append(whole)
    found = ((start, last - start + 1, d) for (start, d), last in farthest.items())
    return sorted((s, n, d) for s, n, d in found if n >= max(LEAST, EXPONENT * d))


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period."""
    numbers = numbered(words)
    out = []
    for lo, hi in candidates(numbers):
        out += [(lo + s, n, d) for s, n, d in runs_in(numbers[lo:hi].tolist())]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run holds after its first period, joined by a space."""
    if not found:
        return b" ".join(words)
    inside = np.zeros(len(words) + 1, dtype=np.int64)
    for start, n, period in found:
        inside[start + period] += 1
        inside[start + n] -= 1
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()])


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", change: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """id, n_words, runs (start, length, period, by start and period), collapsed (the text without repetitions) of every
    row. change: what is done to the words of an id before."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [raw.split() for raw in utf8(part.column("text"))]  # bytes.split parts at ASCII white space
                if change:
                    texts = [change(i, w) for i, w in zip(part.column("id").to_pylist(), texts, strict=True)]
                found = [runs(w) for w in texts]
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "n_words": pa.array([len(w) for w in texts], pa.int64()),
                        "runs": pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own in found], pa.list_(RUN)),
                        "collapsed": pa.array([collapsed(w, own) for w, own in zip(texts, found, strict=True)], pa.binary()).cast(pa.string()),
                    }
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(work, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)
