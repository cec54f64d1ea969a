"""Media columns: audio features.

Bytes are kept as 8-bit mono samples in a WAV container. From the samples read
back: polyphase resampling (2/3), overlapped log-mel filterbanks, and energy
segmentation with hysteresis. Frames are grouped into windows of
``WINDOW`` x ``MELS`` values, so each tensor has the same shape, with its time
span in milliseconds; the last window is padded with the floor value.

Null text is empty; every payload has at least ``BLOCK`` bytes.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, RATE = 576, 12_000
UP, DOWN = 2, 3
FRAME, HOP, MELS, WINDOW = 256, 128, 24, 64
FLOOR = -12.0

SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "segments array<struct<start_ms:long,end_ms:long>>, windows array<struct<start_ms:long,end_ms:long,tensor:array<float>>>, media binary"
)


def to_wav(payload: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(payload)
        return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def low_pass(up: int, down: int, taps: int = 12) -> np.ndarray:
    """A windowed sinc at the lower of both Nyquist rates, at the raised rate."""
    n = np.arange(2 * taps * max(up, down) // 2 + 1) - taps * max(up, down) // 2
    cut = 1.0 / max(up, down)
    h = cut * np.sinc(cut * n) * np.hamming(len(n))
    return up * h / h.sum()


def resample(x: np.ndarray, up: int, down: int, h: np.ndarray) -> np.ndarray:
    """Polyphase: each output phase uses its own part of the filter, no zeros are multiplied."""
    size = -(-len(x) * up // down)
    y, lead = np.zeros(size), (len(h) - 1) // 2
    for r in range(min(up, size)):
        at = r * down + lead  # place of the first output of this phase at the raised rate, with the delay taken out
        phase, first = at % up, at // up
        part = np.convolve(x, h[phase::up])
        mine = part[first::down]
        want = len(y[r::up])
        y[r::up][: min(want, len(mine))] = mine[:want]
    return y


def mel_bank(rate: float, frame: int, mels: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


_FILTER, _BANK, _HANN = low_pass(UP, DOWN), mel_bank(RATE * UP / DOWN, FRAME, MELS), np.hanning(FRAME)
_MS = 1000 * HOP * DOWN / (RATE * UP)


def log_mel(x: np.ndarray) -> np.ndarray:
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((len(frames), MELS), np.float32)
    for i in range(0, len(frames), 4096):
        power = np.abs(np.fft.rfft(frames[i : i + 4096] * _HANN)) ** 2
        out[i : i + 4096] = np.round(np.log10(np.maximum(power @ _BANK, 10**FLOOR)), 2)
    return out


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames above the low threshold (mean) that reach the high one (mean + half a deviation)."""
    low, high = level.mean(), level.mean() + 0.5 * level.std()
    on = np.diff(np.concatenate([[0], (level > low).astype(np.int8), [0]]))
    return [(a, b) for a, b in zip(np.flatnonzero(on == 1).tolist(), np.flatnonzero(on == -1).tolist(), strict=True) if level[a:b].max() > high]


def describe(body: bytes, full: bool) -> tuple:
    payload = body + b"\xff" * ((-len(body)) % BLOCK or (0 if body else BLOCK))
    media = to_wav(payload)
    back = from_wav(media)
    x = (np.frombuffer(back, np.uint8).astype(np.float64) - 128) / 128
    mel = log_mel(resample(x, UP, DOWN, _FILTER))
    spans = [(round(a * _MS), round(b * _MS)) for a, b in segments(np.round(mel.mean(axis=1), 2))]
    padded = np.full((-(-len(mel) // WINDOW) * WINDOW, MELS), FLOOR, np.float32)
    padded[: len(mel)] = mel
    digest = hashlib.sha256(padded.astype("<f4").tobytes() + np.array(spans, "<i8").tobytes()).hexdigest()
    feature = f"{len(mel)}x{MELS};segments={len(spans)};{digest}"
    tensors = [{"start_ms": round(i * WINDOW * _MS), "end_ms": round(min(len(mel), (i + 1) * WINDOW) * _MS), "tensor": t.ravel()} for i, t in enumerate(padded.reshape(-1, WINDOW, MELS))] if full else None
    return (len(body), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, [{"start_ms": a, "end_ms": b} for a, b in spans], tensors, media if full else None)


def audio_features(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", full: bool = True) -> DataFrame:
    """Per row of ``docs`` the columns of ``SCHEMA``; without ``full``, tensors and stored media stay null."""
    spark = docs.sparkSession
    types = spark.createDataFrame([], SCHEMA).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256 if full else 4096
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                rows = [describe(t.as_py() or b"", full) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True))], schema=arrow)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("b")).mapInArrow(run, SCHEMA)


def tensor_array(windows: pa.Array) -> pa.Array:
    """The ``tensor`` field of exploded windows as an Arrow fixed-shape tensor column of WINDOW x MELS."""
    flat = pa.array(np.asarray(windows.flatten(), np.float32))
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (WINDOW, MELS)), pa.FixedSizeListArray.from_arrays(flat, WINDOW * MELS))
