"""Media columns: 8-bit audio stored losslessly, and its features.

A payload of bytes is stored as a mono RIFF/WAVE file of unsigned 8-bit samples in a binary column. Features come
from the stored bytes: a polyphase filter resamples to FEATURE_RATE, overlapped frames pass a log-mel filterbank,
and frame energy with two thresholds (hysteresis) gives segments with start and end times. Log-mel frames are cut
into windows of a fixed shape, which Arrow keeps as fixed-shape tensors beside their time spans.

Null text counts as empty (64 zero bytes); equal texts give equal bytes and features, since every clip is worked on
by itself in double precision; an empty table gives no rows; repeated rows are stored each; clips of any length are
read whole, in blocks of bounded size; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import common

RATE, FEATURE_RATE = 16_000, 8_000
FRAME, HOP, FFT, MELS = 200, 80, 256, 24
#: Frames of a tensor, and of the block of samples worked on at once.
WINDOW, BLOCK_FRAMES = 32, 4096
#: Log-mel values are kept in steps of one in STEPS (about 0.07 dB), so that Parquet keeps them by a small dictionary.
STEPS = 64
#: A segment opens above the upper and closes below the lower of these shares of the clip's energy range.
OPEN, CLOSE, LEAST_FRAMES = 0.6, 0.4, 3
PAD = 64


def pad(payload: bytes, multiple: int = PAD) -> bytes:
    """The payload with bytes 0 appended, up to a positive multiple of some bytes."""
    return payload + bytes(max(multiple, -(-len(payload) // multiple) * multiple) - len(payload))


def to_wave(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAVE file of unsigned 8-bit samples; an odd count gets the format's padding byte."""
    odd = len(samples) % 2
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(samples) + odd, b"WAVE") + form + struct.pack("<4sI", b"data", len(samples)) + samples + bytes(odd)


def from_wave(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of a mono 8-bit WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is read")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no samples")


@cache
def phases(up: int, down: int, taps: int = 16) -> np.ndarray:
    """The phases of a windowed-sinc low-pass filter: row p makes the outputs whose time lies p/up after an input."""
    n = -(-taps * max(up, down) // (2 * up)) * 2 * up
    t = np.arange(n) - n // 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h / h.sum() * up).reshape(-1, up).T.copy()


def resample(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Polyphase resampling: each output is a product of the inputs around it with its own phase of the filter."""
    if rate == to:
        return x
    up, down = to // gcd(rate, to), rate // gcd(rate, to)
    bank = phases(up, down)
    taps = bank.shape[1]
    n_out = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(taps // 2 - 1), x, np.zeros(taps)))
    out = np.empty(n_out)
    view = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for p in range(up):  # outputs k with (k * down) % up == p, evenly spaced in the input
        first = next((k for k in range(up) if (k * down) % up == p), None)
        if first is None or first >= n_out:
            continue
        k = np.arange(first, n_out, up)
        at, step = first * down // up, down
        out[k] = view[at : at + step * len(k) : step] @ bank[p][::-1]
    return out


@cache
def filterbank(rate: int = FEATURE_RATE) -> np.ndarray:
    """Triangles evenly spaced in mel, as a matrix from spectrum bins to mel bands."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, FFT // 2 + 1)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames by mel bands, of overlapped Hann frames; a clip shorter than a frame is padded to one."""
    if len(x) < FRAME:
        x = np.concatenate((x, np.zeros(FRAME - len(x))))
    n = 1 + (len(x) - FRAME) // HOP
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank, parts = np.hanning(FRAME), filterbank(), []
    for i in range(0, n, BLOCK_FRAMES):
        spectrum = np.fft.rfft(view[i : i + BLOCK_FRAMES] * window, FFT)
        parts.append(np.log((spectrum.real**2 + spectrum.imag**2) @ bank + 1e-6))
    return np.concatenate(parts)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frames of runs that rise above the upper threshold and last until they fall below the lower one."""
    low, high = np.quantile(energy, (0.05, 0.95))
    if high <= low:
        return []
    opens, closes = energy >= low + OPEN * (high - low), energy < low + CLOSE * (high - low)
    marks = np.flatnonzero(opens | closes)
    state = np.where(opens[marks], 1, 0)
    turns = np.flatnonzero(np.diff(np.concatenate(([0], state, [0]))))
    starts, ends = turns[::2], turns[1::2]
    bounds = np.append(marks, len(energy))
    return [(int(bounds[a]), int(bounds[b])) for a, b in zip(starts, ends) if bounds[b] - bounds[a] >= LEAST_FRAMES]


def features(samples: bytes, rate: int) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """(log-mel frames, time spans in seconds) of a clip of unsigned 8-bit samples."""
    x = resample((np.frombuffer(samples, np.uint8) - 128.0) / 128.0, rate, FEATURE_RATE)
    mel = log_mel(x)
    return mel, [(a * HOP / FEATURE_RATE, ((b - 1) * HOP + FRAME) / FEATURE_RATE) for a, b in segments(mel.mean(axis=1))]


def store(docs: DataFrame, path: str) -> DataFrame:
    """Write doc_id, n_bytes and media (a WAVE file for each text's padded UTF-8) as Parquet, and read it back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            payloads = [t.encode() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(map(len, payloads), pa.int64()), pa.array([to_wave(pad(p)) for p in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])

    made = common.id_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")
    made.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(made.schema).parquet(path)


def digest(mel: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """A clip's features in a line: frames, segments, seconds inside them, and the mean of every band."""
    return f"{len(mel)} frames, {len(spans)} segments, {sum(b - a for a, b in spans):.3f} s; " + " ".join(f"{x + 0.0:.2f}" for x in mel.mean(axis=0))


def tensors(mel: pa.Array) -> pa.ExtensionArray:
    """Lists of WINDOW * MELS floats as Arrow's fixed-shape tensors of WINDOW by MELS."""
    kind = pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS), dim_names=("frame", "mel"))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(mel.flatten().cast(pa.float32()), WINDOW * MELS))


def measure(stored: DataFrame, path: str) -> DataFrame:
    """Checksums and features of every stored clip, from its stored bytes, as Parquet that is read back.

    Features are n_frames, spans (start_s and end_s of the segments) and mel, a list of windows of a fixed shape
    (WINDOW * MELS floats in steps of one in STEPS, row by row; the last one is padded with its last frame), which
    tensors() types.
    """
    span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "n_frames": pa.int32(), "spans": span}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], [np.empty((0, WINDOW * MELS), np.float32)]
            for doc, n, media in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media")):
                media = media.as_py()
                payload, rate = from_wave(media)
                mel, spans = features(payload, rate)
                held.append(np.pad((np.round(mel * STEPS) / STEPS).astype(np.float32), ((0, -len(mel) % WINDOW), (0, 0)), mode="edge").reshape(-1, WINDOW * MELS))
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), len(mel), [{"start_s": a, "end_s": z} for a, z in spans]))
            ends, flat = np.cumsum([len(x) for x in held]), np.concatenate(held)
            each = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * (WINDOW * MELS)), pa.array(flat.ravel()))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds.values())]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each)], [*kinds, "mel"])

    made = stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames int, spans array<struct<start_s:double,end_s:double>>, mel array<array<float>>")
    made.write.option("compression", "zstd").parquet(path)
    return stored.sparkSession.read.schema(made.schema).parquet(path)


def describe(measured: DataFrame) -> DataFrame:
    """What measure() has of every clip, with its features in a line (feature), from the tensors and the time spans."""
    kept = [c for c in measured.columns if c != "mel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mel = b.column("mel")
            frames = tensors(mel.flatten()).to_numpy_ndarray().reshape(-1, MELS)
            starts = (mel.offsets.to_numpy() - mel.offsets[0].as_py()).tolist()
            told = [digest(frames[s * WINDOW : s * WINDOW + n].astype(np.float64), [(x["start_s"], x["end_s"]) for x in spans]) for s, n, spans in zip(starts, b.column("n_frames").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(told, pa.string())], [*kept, "feature"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in measured.schema if f.name in kept)
    return measured.mapInArrow(run, f"{schema}, feature string")


def windows(measured: DataFrame) -> DataFrame:
    """doc_id, window, start_s, end_s, in_segment and mel of every window of every clip that measure() has."""
    rows = measured.select("doc_id", "spans", F.posexplode("mel").alias("window", "mel"))
    start = F.col("window") * WINDOW * HOP / FEATURE_RATE
    end = start + ((WINDOW - 1) * HOP + FRAME) / FEATURE_RATE
    inside = F.exists("spans", lambda s: (s["start_s"] < end) & (s["end_s"] > start))
    return rows.select("doc_id", "window", start.alias("start_s"), end.alias("end_s"), inside.alias("in_segment"), "mel")


def as_tensors(batch: pa.RecordBatch | pa.Table) -> pa.Table:
    """An Arrow table of windows() with mel as fixed-shape tensors of WINDOW by MELS."""
    table = pa.table(batch)
    mel = tensors(table.column("mel").combine_chunks())
    return table.set_column(table.schema.get_field_index("mel"), pa.field("mel", mel.type), mel)


def digests(docs: DataFrame) -> DataFrame:
    """Checksums, time spans and features of every document: stored, read back, measured, and told from what was measured."""
    spark = docs.sparkSession
    stored = store(docs, common.scratch(spark, "media"))
    return describe(measure(stored, common.scratch(spark, "features"))).select("*", (F.col("payload_bytes") / RATE).alias("seconds"))
