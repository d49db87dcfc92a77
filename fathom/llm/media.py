"""Media columns: payloads as 8-bit WAV, read by the wave module, with spectral fingerprints.

``encode`` packs each text's bytes, padded with 255 to a positive multiple of
576, as unsigned 8-bit mono samples of a WAV file, losslessly. ``features``
reads such a column back, takes a short-time Fourier transform (Hann windows of
256 samples, hop 128, and one that ends with the last sample), keeps each frame
whose strongest bin is a maximum over the neighbouring frames, and pairs each
peak with the next ``FAN`` peaks. A fingerprint is two time-coded arrays: the
peak's frame number and the pair's code (first bin, second bin, distance in
frames, in 16, 8 and 32 bits).

Both are maps of single rows without a shuffle; the query stores the media
column as a table between them. Frames of a long sample run are transformed
``FRAMES`` at a time. Results for odd input: null or empty text is
576 bytes of padding; repeated rows and null ids give a row each; silence has no
peaks and empty arrays; other columns are ignored.
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

from . import blocks

UNIT = 576
RATE = 8000
SIZE, HOP, FAN, NEAR = 256, 128, 3, 2
FRAMES = 4096
SLICE = 4 << 20
_WINDOW = np.hanning(SIZE).astype(np.float32)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in blocks.chunks(batch.column(1), SLICE):
            sizes, media = np.diff(bounds), []
            for a, n in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True):
                media.append(to_wav(data[a : a + n].tobytes() + b"\xff" * (max(UNIT, -(-n // UNIT) * UNIT) - n)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes.astype(np.int64)), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks of 8-bit samples."""
    starts = np.arange(0, len(samples) - SIZE + 1, HOP)
    if starts[-1] < len(samples) - SIZE:
        starts = np.append(starts, len(samples) - SIZE)
    frames = np.lib.stride_tricks.sliding_window_view(samples, SIZE)
    bins, power = [], []
    for lo in range(0, len(starts), FRAMES):
        part = frames[starts[lo : lo + FRAMES]].astype(np.float32)
        part = (part - part.mean(axis=1, keepdims=True)) * _WINDOW
        spectrum = np.fft.rfft(part, axis=1)[:, 1:]
        strength = spectrum.real**2 + spectrum.imag**2
        best = strength.argmax(axis=1)
        bins.append(best + 1)
        power.append(strength[np.arange(len(best)), best])
    bins, power = np.concatenate(bins), np.concatenate(power)
    around = np.pad(power, NEAR, constant_values=-1.0)
    near = np.lib.stride_tricks.sliding_window_view(around, 2 * NEAR + 1).max(axis=1)
    at = np.flatnonzero((power >= near) & (power > 1.0))
    return at, bins[at]


def pairs(at: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pair arrays: frame of the first peak, and both bins with their distance."""
    times, codes = [], []
    for k in range(1, FAN + 1):
        gap = at[k:] - at[:-k]
        times.append(at[: len(gap)])
        codes.append(bins[: len(gap)] << 40 | bins[k:] << 32 | gap)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int64)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<long>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.strip().split()[0] for x in _FEATURES.split(",")]
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            cols: list[list] = [[] for _ in range(7)]
            for media in part.column(2):
                stored = media.as_py()
                payload = from_wav(stored)
                t, c = pairs(*peaks(np.frombuffer(payload, np.uint8)))
                for col, value in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), t, c), strict=True):
                    col.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column (WAV files) of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored WAV files hold, read back, with fingerprint arrays times and codes."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)
