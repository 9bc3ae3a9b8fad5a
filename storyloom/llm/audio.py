"""Audio media columns: 8-bit WAV in a binary column, and log-mel features of speech-like segments.

A payload is stored as unsigned 8-bit mono samples in a WAV container, in a media table of its own, and read back from that.
The samples are resampled by a polyphase filter (UP phases of taps, every DOWN-th output kept), cut into overlapped frames and turned into log-mel energies; a hysteresis on the frame energy finds
segments; each segment's frames are pooled to a patch of fixed shape (FRAMES x MELS), kept as an Arrow fixed-shape
tensor beside its time span.

Null text counts as empty, an empty payload is 64 zero bytes; each row gets its features, repeated rows equal ones. Work
goes in blocks, so a very long text needs memory for its samples only. Extra columns stay out of the result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored, utf8

UNIT = 64
RATE, UP, DOWN, HALF_TAPS = 16_000, 5, 8, 12
FRAME, HOP, MELS, FRAMES = 256, 128, 24, 8
#: A segment opens at the mean frame energy plus so many standard deviations, and closes below the second.
OPEN_AT, CLOSE_AT = 1.0, 0.25
BLOCK = 1 << 16


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as unsigned 8-bit mono PCM; an odd length gets the container's padding byte."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(raw: bytes) -> tuple[int, bytes]:
    """Rate and samples of an 8-bit mono PCM file; chunks that are not needed are passed over."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, rate = 12, None
    while at + 8 <= len(raw):
        name, size = struct.unpack_from("<4sI", raw, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", raw, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            if rate is None or at + 8 + size > len(raw):
                raise ValueError("the WAV file is cut off")
            return rate, raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("the WAV file has no samples")


@lru_cache(maxsize=8)
def phases(up: int, down: int, half: int = HALF_TAPS) -> np.ndarray:
    """The windowed-sinc low-pass of the narrower rate, as one row of taps per phase."""
    n = np.arange(-half * up * max(1, -(-down // up)), half * up * max(1, -(-down // up)) + 1)
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * n) * np.hanning(len(n) + 2)[1:-1] * up
    h = np.concatenate([h, np.zeros(-len(h) % up)])
    return np.ascontiguousarray(h.reshape(-1, up).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """x at up / down times its rate; ceil(len * up / down) samples."""
    taps = phases(up, down)
    width = taps.shape[1]
    n = -(-len(x) * up // down)
    lead = (width * up - 1) // 2 // up
    padded = np.concatenate([np.zeros(width - 1 - lead, np.float32), x.astype(np.float32), np.zeros(width + lead + down, np.float32)])
    frames = sliding_window_view(padded, width)
    out = np.empty(n, dtype=np.float32)
    for p in range(min(up, n)):
        phase, at = (p * down) % up, (p * down) // up
        count = -(-(n - p) // up)
        own = out[p::up]
        for k in range(0, count, BLOCK):
            block = frames[at + k * down : at + min(k + BLOCK, count) * down : down][: count - k]
            own[k : k + len(block)] = block @ taps[phase]
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters at equal steps of the mel scale: (frame / 2 + 1, mels)."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    hz = np.linspace(0, rate / 2, frame // 2 + 1)[:, None]
    rise, fall = (hz - edges[:-2]) / np.diff(edges)[:-1], (edges[2:] - hz) / np.diff(edges)[1:]
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) log energies and each frame's energy in decibels; silence fills the last frame, so that it covers the end."""
    if rest := FRAME - len(y) if len(y) < FRAME else -(len(y) - FRAME) % HOP:
        y = np.concatenate([y, np.zeros(rest, np.float32)])
    frames = sliding_window_view(y, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mel, level = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for at in range(0, len(frames), 2048):
        spectrum = np.fft.rfft(frames[at : at + 2048] * window, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mel[at : at + 2048] = np.log(power @ bank + 1e-6)
        level[at : at + 2048] = 10 * np.log10(power.sum(axis=1) + 1e-6)
    return mel, level


def hysteresis(level: np.ndarray, open_at: float, close_at: float) -> list[tuple[int, int]]:
    """The runs of frames above close_at that somewhere exceed open_at, as (first, end)."""
    above = np.concatenate([[False], level > close_at, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1]).reshape(-1, 2)
    peaks = np.concatenate([[0], np.cumsum(level > open_at)])
    return [(int(a), int(b)) for a, b in edges if peaks[b] > peaks[a]]


def pooled(mel: np.ndarray, frames: int = FRAMES) -> np.ndarray:
    """A segment's frames averaged to a fixed number of them; a shorter segment repeats frames."""
    n = len(mel)
    bounds = np.arange(frames + 1) * n / frames
    first = np.minimum(np.floor(bounds[:-1]).astype(int), n - 1)
    last = np.maximum(np.ceil(bounds[1:]).astype(int), first + 1)
    sums = np.concatenate([np.zeros((1, mel.shape[1])), np.cumsum(mel, axis=0, dtype=np.float64)])
    return ((sums[last] - sums[first]) / (last - first)[:, None]).astype(np.float32)


def analysed(samples: bytes, rate: int) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Segments in milliseconds, their patches (n, FRAMES, MELS), and all frames' log-mel energies."""
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y, own_rate = resample(x), rate * UP // DOWN
    mel, level = log_mel(y, own_rate)
    middle, spread = float(level.mean(dtype=np.float64)), float(level.std(dtype=np.float64))
    runs = hysteresis(level, middle + OPEN_AT * spread, middle + CLOSE_AT * spread)
    spans = [(a * HOP * 1000 // own_rate, min((b - 1) * HOP + FRAME, len(y)) * 1000 // own_rate) for a, b in runs]
    patches = np.stack([pooled(mel[a:b]) for a, b in runs]) if runs else np.empty((0, FRAMES, MELS), np.float32)
    return spans, patches, mel


def tensors(patches: np.ndarray) -> pa.Array:
    """Patches as an Arrow fixed-shape tensor array."""
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(patches))


def as_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: each text's bytes, filled up to a multiple of UNIT, as a WAV file. One narrow stage."""
    kind = df.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = utf8(part.column("text"))
                media = [to_wav(raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)) for raw in texts]
                yield pa.record_batch({"id": part.column("id"), "n_bytes": pa.array(map(len, texts), pa.int64()), "media": pa.array(media, pa.binary())})

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, f"id {kind}, n_bytes long, media binary")


SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans array<struct<start_ms:long,end_ms:long>>, patches array<array<float>>"


def patch_lists(patches: list[np.ndarray]) -> pa.Array:
    """Per row the storage of its fixed-shape tensors, each FRAMES x MELS values in row-major order."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in patches])])
    flat = tensors(np.concatenate(patches)).storage.values if ends[-1] else pa.array([], pa.float32())
    each = pa.ListArray.from_arrays(pa.array(np.arange(ends[-1] + 1) * FRAMES * MELS, pa.int32()), flat)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)


def media_features(media: DataFrame, with_media: bool = True) -> DataFrame:
    """(id, n_bytes, media) with what the stored bytes hold: id, SCHEMA, and media if asked for. One narrow stage."""
    kind = media.schema["id"].dataType.simpleString()

    def one(raw: bytes) -> tuple:
        rate, back = from_wav(raw)
        spans, patches, mel = analysed(back, rate)
        rounded = np.round(np.concatenate([mel.mean(axis=0, dtype=np.float64), patches.ravel()]), 3)
        digest = hashlib.sha256(repr(spans).encode() + rounded.tobytes()).hexdigest()
        feature = f"{len(mel)}x{MELS}:{len(spans)}:{digest[:32]}"
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, [{"start_ms": a, "end_ms": b} for a, b in spans], patches

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), SPANS]
        names = ["id", *(x.split()[0] for x in SCHEMA.split(", "))]
        for batch in batches:
            for part in slices(batch, "media"):
                *cols, patches = zip(*map(one, part.column("media").to_pylist()), strict=True)
                own = [part.column("id"), part.column("n_bytes"), *map(pa.array, cols, kinds), patch_lists(list(patches))]
                yield pa.record_batch([*own, part.column("media")] if with_media else own, names=[*names, "media"] if with_media else names)

    return media.mapInArrow(work, f"id {kind}, {SCHEMA}" + (", media binary" if with_media else ""))


def audio_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each text's bytes as audio, reads the stored table and analyses it. patches are the tensors' storage, row-major
    FRAMES x MELS per segment, beside their spans; as_tensors() gives them their shape again. Two narrow stages."""
    return media_features(stored(as_media(df, id_col, text_col), "media"), with_media).withColumnRenamed("id", id_col)


def as_tensors(patches: pa.Array) -> pa.Array:
    """The patches column of collected rows (all segments in order) as one fixed-shape tensor array."""
    flat = patches.flatten().flatten()
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))
