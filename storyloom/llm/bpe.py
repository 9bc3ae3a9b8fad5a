"""Byte-level BPE by a pair occurrence index.

The distinct pretokens of a slice of a partition lie in one array of symbols. An index maps each adjacent pair to all
its positions. The active pairs are applied in ascending rank: a merge visits the positions listed for its pair and
updates only the lists of the neighbouring pairs. A pretoken that is known from an earlier slice is looked up.

Null text counts as empty, an empty text has no ids. Rows that repeat are encoded each; extra columns stay out of the
result. The string of an added token in a text becomes its id, as the tokenizers library does by default.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import slices

#: The public pretokenizer pattern of this family of vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on texts of the characters in NARROW only, where the standard library's faster engine agrees with it.
NARROW_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+")
NOT_NARROW = re.compile(r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ɏ]")
#: Pretokens remembered by a worker.
CACHE = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stands = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in stands:
            stands[b] = chr(spare)
            spare += 1
    return [stands[b] for b in range(256)]


class PairIndexBPE:
    """Encoder and decoder for a byte-level vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        self.size = 1 << (max(vocab.values()) + 1).bit_length()
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] * self.size + vocab[b], (rank, vocab[a + b]))
        self.by_rank = {rank: (key, new) for key, (rank, new) in self.merges.items()}
        back = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of.update({i: s.encode() for s, i in self.added.items()})
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.wide = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def pretokens(self, text: str) -> list[str]:
        return (self.wide if NOT_NARROW.search(text) else NARROW_PATTERN).findall(text)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word as packed uint32, by one pass of ascending ranks over all of them."""
        first, size, merges, by_rank = self.first, self.size, self.merges, self.by_rank
        sym: list[int] = []
        bounds = [0]
        for w in words:
            sym += [first[b] for b in w.encode()]
            sym.append(-1)  # keeps words apart
            bounds.append(len(sym))
        n = len(sym)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for i in range(n - 1):
            if sym[i] >= 0 and sym[i + 1] >= 0:
                found = merges.get(sym[i] * size + sym[i + 1])
                if found:
                    index.setdefault(found[0], []).append(i)
        active = list(index)
        heapq.heapify(active)
        get, push = merges.get, heapq.heappush
        while active:
            rank = heapq.heappop(active)
            key, new = by_rank[rank]
            a, b = divmod(key, size)
            places = index.pop(rank)
            places.sort()
            for i in places:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if j >= n or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                k = nxt[i] = nxt[j]
                if k < n:
                    prv[k] = i
                    if sym[k] >= 0:
                        found = get(new * size + sym[k])
                        if found:
                            at = index.get(found[0])
                            if at is None:
                                index[found[0]] = [i]
                                push(active, found[0])
                            else:
                                at.append(i)
                h = prv[i]
                if h >= 0 and sym[h] >= 0:
                    found = get(sym[h] * size + new)
                    if found:
                        at = index.get(found[0])
                        if at is None:
                            index[found[0]] = [h]
                            push(active, found[0])
                        else:
                            at.append(h)
        flat = np.array(sym, dtype=np.int64)
        left = flat >= 0
        counts = np.concatenate([[0], np.cumsum(left)])[bounds]
        packed, counts = flat[left].astype("<u4").tobytes(), (counts * 4).tolist()
        return [packed[counts[k] : counts[k + 1]] for k in range(len(words))]

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as packed little-endian uint32."""
        parts: list[list] = []
        for text in texts:
            if self.split_added and self.split_added.search(text):
                own, at = [], 0
                for m in self.split_added.finditer(text):
                    own += [*self.pretokens(text[at : m.start()]), self.added[m[0]]]
                    at = m.end()
                parts.append(own + self.pretokens(text[at:]))
            else:
                parts.append(self.pretokens(text))
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        found: set = set()
        for own in parts:
            found.update(own)
        found.difference_update(known)
        for k in [w for w in found if isinstance(w, int)]:
            known[k] = k.to_bytes(4, "little")
            found.discard(k)
        fresh = list(found)
        known.update(zip(fresh, self.merge_words(fresh), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, own)) for own in parts]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed([text])[0], dtype="<u4").tolist()

    def decode_bytes(self, packed: bytes) -> bytes:
        """The text of packed ids in UTF-8; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()
        return raw


@lru_cache(maxsize=2)
def load(path: str) -> PairIndexBPE:
    return PairIndexBPE(path)


def encode_documents(df: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, n_tokens, ids (packed little-endian uint32; null unless with_ids), ids_sha256, decoded_sha256 for every row.

    One narrow stage: no shuffle; a worker holds a slice of texts and a bounded cache."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab)
        for batch in batches:
            for part in slices(batch, "text"):
                packed = bpe.encode_packed([x or "" for x in part.column("text").to_pylist()])
                yield pa.record_batch(
                    {
                        "id": part.column("id"),
                        "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                        "ids": pa.array(packed if with_ids else [None] * len(packed), pa.binary()),
                        "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                        "decoded_sha256": pa.array([hashlib.sha256(bpe.decode_bytes(p)).hexdigest() for p in packed]),
                    }
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(work, f"id {kind}, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, vocab: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """df with the text of its packed ids added (null ids: null)."""
    schema = StructType([*df.schema.fields, StructField(out_col, StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab)
        for batch in batches:
            texts = [None if p is None else bpe.decode_bytes(p).decode() for p in batch.column(ids_col).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return df.mapInArrow(work, schema)
