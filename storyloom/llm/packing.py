"""Best-two-fit packing of tokenized documents into sequences of fixed length.

A document is its ids and a closing id. Only a document longer than a sequence is cut, into full pieces; its first piece
takes the remainder. Full pieces are sequences of their own. The others are packed in blocks of about BLOCK pieces, each
by one task: a sequence is filled greedily with the longest piece that fits; when none does, its smallest document gives
way to two unpacked ones, if two fit the expanded gap more tightly. A block leaves at most a few sequences part filled,
which is a share of well under a thousandth of its sequences.

Null text counts as empty; an empty document is its closing id alone. Rows that repeat are packed each. Extra columns
stay out of the result.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .bpe import PATTERN, byte_symbols, load
from .common import slices, stored

LENGTH, CLOSING, BLOCK = 2048, 0, 200_000
PIECE = "piece int, start long, length long, ids_crc32 long, ids binary"


@lru_cache(maxsize=2)
def load_encoder(path: str):
    """The vocabulary file of the tokenizers library as a tiktoken encoding: ids and special tokens are the same."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    back = {s: b for b, s in enumerate(byte_symbols())}
    added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    ranks = {bytes(back[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in added}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)


def encoded(text: str, vocab: str) -> np.ndarray:
    """The ids of a text. The encoder's pattern engine gives up on very long runs of white space; the pair index does not."""
    encoder = load_encoder(vocab)
    try:
        return encoder.encode_to_numpy(text, allowed_special="all")
    except ValueError:
        if not vocab.endswith(".json"):
            raise
        return np.frombuffer(load(vocab).encode_packed([text])[0], dtype="<u4")


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


def pieces(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, closing: int = CLOSING, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of df, in one narrow stage."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([closing], dtype=np.uint32)
        for batch in batches:
            for part in slices(batch, "text"):
                at, rows = [], []
                for k, text in enumerate(part.column("text").to_pylist()):
                    ids = np.concatenate([encoded(text or "", vocab), tail]).astype("<u4")
                    for piece, (start, n) in enumerate(cut(len(ids), length)):
                        own = ids[start : start + n].tobytes()
                        at.append(k)
                        rows.append((piece, start, n, zlib.crc32(own), own if with_ids else None))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([part.column("id").take(pa.array(at)), *map(pa.array, cols, kinds)], names=["id", "piece", "start", "length", "ids_crc32", "ids"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, {PIECE}")


def best_two_fit(lengths: np.ndarray, size: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item. Items of a length are alike, so the unpacked ones are counts by length."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=size + 1).tolist()
    ends = np.cumsum(counts).tolist()  # the items of length n are order[ends[n - 1] : ends[n]], taken from the end
    left = counts[:]
    lower = [n if c else -1 for n, c in enumerate(counts)]  # the next length at or below that has items, with path halving

    def fitting(n: int) -> int:
        while n > 0 and lower[n] != n:
            step = lower[n] if lower[n] >= 0 else n - 1
            if lower[step] != step and step > 0:
                lower[n] = lower[step] if lower[step] >= 0 else step - 1
            n = step
        return n

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            lower[n] = n - 1

    def give(n: int) -> None:
        left[n] += 1
        if left[n] == 1:
            lower[n] = n
            for m in range(n + 1, size + 1):  # lengths above without items may point past n
                if left[m]:
                    break
                lower[m] = m - 1

    bins: list[list[int]] = []
    while (longest := fitting(size)) > 0:
        own, gap = [], size
        while gap > 0 and (n := fitting(gap)) > 0:
            take(n)
            own.append(n)
            gap -= n
        if gap > 0 and longest > 0:
            small = own[-1]
            room, best, pair = gap + small, small, None
            a = fitting(room - 1)
            while a > 0 and 2 * a > best:
                b = fitting(min(a, room - a))
                if b == a and left[a] < 2:
                    b = fitting(a - 1)
                if b > 0 and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = fitting(a - 1)
            if pair:
                own[-1:] = pair
                for n in pair:
                    take(n)
                give(small)
                gap = room - best
        bins.append(own)
    which, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    ends = ends[:]
    for k, own in enumerate(bins):
        at = 0
        for n in own:
            ends[n] -= 1
            item = order[ends[n]]
            which[item], offset[item] = k, at
            at += n
    return which, offset


def pack(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, closing: int = CLOSING, block: int = BLOCK, with_ids: bool = False) -> DataFrame:
    """The pieces of df with sequence_id and offset: each sequence's pieces follow one another from 0."""
    rows = stored(pieces(df, vocab, id_col, text_col, length, closing, with_ids), "pieces")
    whole, parts = rows.filter(F.col("length") == length), rows.filter(F.col("length") < length)
    blocks = max(1, -(-parts.count() // block))
    schema = StructType([*rows.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).combine_chunks() if (batches := list(batches)) else None
        if rows is None or not rows.num_rows:
            return
        which, offset = best_two_fit(rows["length"].to_numpy(), length)
        number = int(rows["block"][0].as_py())
        out = rows.drop_columns(["block"]).append_column("sequence_id", pa.array((which + (number << 31)) * 2, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        yield from out.to_batches()

    # by the stored row, not by its id, which may repeat or be null; each block is one task's
    light = parts if with_ids else parts.drop("ids")
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
    dealt = light.select("*", key).repartitionById(blocks, F.col("block").cast("int")).sortWithinPartitions("id", "piece", "start", "length", "ids_crc32")
    packed = dealt.mapInArrow(work, StructType([*light.schema.fields, *schema.fields[-2:]]))
    if not with_ids:
        packed = packed.withColumn("ids", F.lit(None).cast("binary"))
    # full pieces take odd numbers, the packed sequences even ones
    alone = whole.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    out = packed.select(*schema.names).unionByName(alone)
    return out.withColumnRenamed("id", id_col)
