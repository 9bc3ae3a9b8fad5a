"""Vectors: sign bits, Hamming and cosine distances, a deterministic embedder."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.schema import EMBEDDING_CHARS, EMBEDDING_DIMS, EMBED_BATCH, sign_bits

Embedder = Callable[[list[str]], np.ndarray]


def query_bits(vector: Sequence[float]) -> list[int]:
    """sign_bits() of a vector on the driver."""
    out = []
    for at in range(0, len(vector), 64):
        word = sum(1 << i for i, x in enumerate(vector[at : at + 64]) if x > 0)
        out.append(word - (1 << 64) if word >= 1 << 63 else word)
    return out


def rounded(vector: Sequence[float]) -> list[float]:
    """A query vector to six places, as its text form has."""
    return [round(float(x), 6) for x in vector]


def rounded_column(vector: Column) -> Column:
    """`rounded` for a column of vectors, as stored rows that are queries (a batch of them) need it; null stays null."""
    return F.transform(vector, lambda x: F.round(x.cast("double"), 6))


def hamming(bits: Column, wanted: Sequence[int]) -> Column:
    """Differing bits; one long per 64 dimensions stays inside generated code."""
    parts = [F.bit_count(bits[i].bitwiseXOR(F.lit(int(w)))) for i, w in enumerate(wanted)]
    return sum(parts[1:], parts[0])


def cosine_distance(vector: Column, wanted: Sequence[float]) -> Column:
    """1 - cosine in double; null for a zero vector."""
    q = [float(x) for x in wanted]
    norm = math.sqrt(sum(x * x for x in q))
    array = F.array(*map(F.lit, q))
    wide = vector.cast("array<double>")
    dot = F.aggregate(F.zip_with(wide, array, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(length * norm > 0, 1 - dot / (length * norm))


def checked_width(vector: Column, dims: int = EMBEDDING_DIMS) -> Column:
    """The vector, or an error if its width differs: nothing is cut or padded."""
    return F.when(F.assert_true(F.size(vector) == dims, F.lit(f"a vector must have {dims} numbers")).isNull(), vector)


def embedding_text(title: Column, summary: Column) -> Column:
    return F.substring(F.trim(F.concat(title, F.lit(". "), summary)), 1, EMBEDDING_CHARS)


def hashing_embedder(dims: int = EMBEDDING_DIMS) -> Embedder:
    """Hashed words with signs, normalised: deterministic, and it needs no server."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[row, h % dims] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms > 0, norms, 1)

    return run


def embed_missing(stories: DataFrame, embedder: Embedder | None = None, dims: int = EMBEDDING_DIMS, batch: int = EMBED_BATCH) -> DataFrame:
    """(story_id, summary_embedding) of the live stories that have none; partitions replace row locks."""
    run = embedder or hashing_embedder(dims)
    todo = stories.filter(F.col("deleted_at").isNull() & F.col("summary_embedding").isNull()).select("story_id", embedding_text(F.col("title"), F.col("summary")).alias("text"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                vectors = run([x or "" for x in part["text"]])
                if vectors.shape[1] != dims:
                    raise ValueError(f"a vector must have {dims} numbers, the embedder gave {vectors.shape[1]}")
                yield pd.DataFrame({"story_id": part["story_id"], "summary_embedding": list(vectors.astype(np.float32))})

    return todo.mapInPandas(work, "story_id long, summary_embedding array<float>")


__all__ = ["checked_width", "cosine_distance", "embed_missing", "embedding_text", "hamming", "hashing_embedder", "query_bits", "rounded", "sign_bits"]
