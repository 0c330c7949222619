"""Vectorised work on the UTF-8 bytes of an Arrow string column.

All functions take whole batches; nothing here loops over characters or words
in Python. Batches are cut into slices of bounded size by ``slices`` so that the
temporary arrays stay small however long the column is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles (one longer text is a step of its own).
SLICE_BYTES = 800_000

try:
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018  not every C library has it
except (OSError, AttributeError):
    _libc = None

_BASE = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20240229)
_BYTE_MIX = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: ASCII white space, the word separators of the contracts.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Letters as bytes: ASCII letters and every byte of a multi-byte character.
IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("a") : ord("z") + 1] = IS_LETTER[ord("A") : ord("Z") + 1] = True
IS_LETTER[0x80:] = True
#: ASCII lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def trimmed(batches: Iterable) -> Iterator:
    """The batches; after each, memory that is free goes back to the system, since workers outlive their tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _libc is not None:
            _libc.malloc_trim(0)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    _, off = flat(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def runs(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes with ``inside[byte]``, never across texts: starts, ends, text numbers."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    m = inside[data]
    before = np.zeros(n, bool)
    before[1:] = m[:-1]
    first = off[:-1][off[:-1] < n]
    before[first] = False
    start = np.flatnonzero(m & ~before)
    after = np.zeros(n, bool)
    after[:-1] = m[1:]
    last = off[1:][off[1:] > 0] - 1
    after[last] = False
    end = np.flatnonzero(m & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes, equal for equal bytes wherever they stand."""
    n = len(data)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_MIX[data] * up[:n], out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def framed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after another, each between the bytes 1 and 2; offsets of the spans."""
    size = end - start + 2
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    out = np.empty(off[-1], np.uint8)
    if len(start):
        at = np.arange(off[-1]) - np.repeat(off[:-1] - start + 1, size)
        out[:] = data[np.clip(at, 0, max(len(data) - 1, 0))] if len(data) else 0
        out[off[:-1]] = 1
        out[off[1:] - 1] = 2
    return out, off


def gram_buckets(framed_bytes: np.ndarray, off: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """For every byte, the bucket of the gram of ``size`` bytes that starts there; ``buckets`` where it would leave the word."""
    n = len(framed_bytes)
    out = np.full(n, buckets, np.int64)
    if n < size:
        return out
    wide = framed_bytes.astype(np.uint64)
    key = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        key = (key << np.uint64(8)) | wide[k : n - size + 1 + k]
    left = np.repeat(off[1:], np.diff(off))[: n - size + 1] - np.arange(n - size + 1)
    out[: n - size + 1] = np.where(left >= size, (mix(key) % np.uint64(buckets)).astype(np.int64), buckets)
    return out
