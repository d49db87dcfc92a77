"""Vectorised word and byte arrays over Arrow batches of texts.

Every function works on whole texts. A batch is cut into runs of documents of
about ``CHUNK`` bytes, so a task's memory is set by the chunk or by its longest
single text, never by the number of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Spans of up to so many bytes are hashed by one random number per place and byte, longer ones by BLAKE2b.
REACH = 64
_TABLE = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, REACH * 256, dtype=np.uint64)
_ROLL = np.random.Generator(np.random.PCG64(20240608)).integers(0, 2**64, 256, dtype=np.uint64)
_STEP = np.random.Generator(np.random.PCG64(20240609)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words are what lies between ASCII space and control blanks.
BLANK_WORDS = np.ones(256, bool)
BLANK_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Words are digits, lower-case letters and all bytes beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and each row's bounds; null counts as empty."""
    kind = column.type
    wide = pa.large_binary() if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(wide) else "")
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, bounds


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds from 0) for runs of rows of about limit bytes."""
    base = 0
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        raw, bounds = text_arrays(part)
        n, lo = len(bounds) - 1, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
            yield base + lo, base + hi, raw[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
            lo = hi
        base += n


def words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words precede each document (length documents + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = member[data]
    cut = bounds[:-1][bounds[:-1] < bounds[1:]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut[1:] - 1] = inside[cut[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def byte_values(place: int, data: np.ndarray) -> np.ndarray:
    """What bytes at a place of a short span add to its hash."""
    return _TABLE[(place << 8) + data.astype(np.int64)]


def _spread(sizes: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(slice of the spans, head of each, place of every byte within its span) for runs of spans of about limit bytes."""
    reach, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        done = int(reach[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(reach, done + limit, "right")))
        own = sizes[lo:hi]
        heads = np.cumsum(own) - own
        yield slice(lo, hi), heads, np.arange(int(own.sum()), dtype=np.int64) - np.repeat(heads, own)
        lo = hi


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes give equal hashes wherever they stand."""
    sizes = ends - starts
    out = sizes.astype(np.uint64)
    short = np.flatnonzero((sizes > 0) & (sizes <= REACH))
    for part, heads, within in _spread(sizes[short]):
        own = short[part]
        at = np.repeat(starts[own], sizes[own]) + within
        out[own] += np.add.reduceat(_TABLE[(within << 8) + data[at]], heads)
    out = mix(out)
    for k in np.flatnonzero(sizes > REACH).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def rolling_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value for every run of size bytes (a power of two), equal for equal runs.

    Good for choosing places, not for telling runs apart.
    """
    h, reach = _ROLL[data], 1
    while reach < size:
        h = h[:-reach] * _STEP[reach.bit_length()] + h[reach:]
        reach *= 2
    return mix(h)


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a span of each distinct content, the place of every span's content among them); contents are compared byte by byte."""
    first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)[1:]
    sizes, like = ends - starts, first[back]
    same = bool((sizes == sizes[like]).all())
    for part, _, within in _spread(sizes) if same else ():
        a, b = (np.repeat(starts[x], sizes[part]) for x in (part, like[part]))
        same = same and bool((data[a + within] == data[b + within]).all())
    if not same:
        place: dict[bytes, int] = {}
        back = np.array([place.setdefault(data[a:b].tobytes(), len(place)) for a, b in zip(starts, ends, strict=True)])
        first = np.unique(back, return_index=True)[1]
    return first, back


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def lowered_words(data: np.ndarray, bounds: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and how many words precede each document."""
    data = LOWER[data]
    starts, ends, before = words(data, bounds, member)
    return span_hashes(data, starts, ends), before


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
