"""What several operators share: stored intermediate tables, slices of Arrow batches, words and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Texts are worked on in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 4 << 20


def _hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as Spark itself resolves them."""
    jvm = spark.sparkContext._jvm
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own, own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, as a full URI. Where that is unset, a local master (tests, one machine) gets
    one under the temp folder; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    path, store = _hadoop_path(spark, found)
    return store.makeQualified(path).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/storyloom-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, drop: tuple[DataFrame, ...] = ()) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: later steps neither recompute it nor need the executors
    that made it. drop: stored tables that nothing reads from then on; they are deleted."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    for old in drop:
        discard(old)
    return out


def discard(table: DataFrame) -> None:
    """Deletes a table that stored() wrote."""
    path, store = _hadoop_path(table.sparkSession, table.stored_path)
    store.delete(path, True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES, rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of `column`; a single longer value is a part of its own."""
    at, n = 0, batch.num_rows
    if not n:
        return
    col = batch.column(column)
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    while at < n:
        before = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, before + most, side="right"))
        end = min(max(end, at + 1), at + rows, n)
        yield batch.slice(at, end - at)
        at = end


_SHIFTS = [np.uint64(x) for x in (30, 27, 31, 29)]
_FACTORS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15)]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finalizer on an array of uint64 values. Most arrays are a short text's, so that calls count."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    shifted = z >> _SHIFTS[0]
    z ^= shifted
    z *= _FACTORS[0]
    z ^= np.right_shift(z, _SHIFTS[1], out=shifted)
    z *= _FACTORS[1]
    z ^= np.right_shift(z, _SHIFTS[2], out=shifted)
    return z


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash, computed once; the memory is bounded by starting anew."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


#: Words of up to so many bytes are hashed by tables, longer ones one by one.
TABLED = 32
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_TABLE = mix64(np.arange(TABLED * 256, dtype=np.uint64), 21)


def hashed_words(texts: list[bytes], at_once: int = 100_000) -> list[np.ndarray]:
    """A 64-bit hash of each word of each text. Simple tabulation: the sum of a random number per byte and place in the
    word, for `at_once` words together; words over TABLED bytes are hashed whole."""
    if not texts:
        return []
    raw = b"\n".join(texts)
    data = np.frombuffer(raw, dtype=np.uint8)
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = _SPACE[data]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    sizes = ends - starts
    out = np.empty(len(starts), dtype=np.uint64)
    for k in np.flatnonzero(sizes > TABLED).tolist():
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    few = np.flatnonzero(sizes <= TABLED)
    for k in range(0, len(few), at_once):
        part = few[k : k + at_once]
        size = sizes[part]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        values = _TABLE[(place << 8) | data[place + np.repeat(starts[part], size)]]
        out[part] = mix64(np.add.reduceat(values, first))
    bounds = np.searchsorted(starts, np.cumsum([len(x) + 1 for x in texts])[:-1])
    return np.split(out, bounds)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words (order counts); empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, shifted = words[:n].copy(), np.empty(n, dtype=np.uint64)
    for k in range(1, size):
        out *= _FACTORS[2]
        out ^= np.right_shift(out, _SHIFTS[3], out=shifted)
        out += words[k : n + k]
    return mix64(out)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def local_path(uri: str) -> str | None:
    """The path of a file: URI or of a plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith(os.sep) else None


def arrow_uri(uri: str) -> str:
    """A URI as Arrow's file systems name it."""
    return "s3://" + uri.split("://", 1)[1] if uri.startswith(("s3a://", "s3n://")) else uri
