"""Word hashing on Arrow text buffers, for use inside tasks.

Texts are read where Arrow keeps them: one array of UTF-8 bytes and the
offsets of the rows. Words are found and hashed with whole-array numpy
operations, in slices of about ``SLICE`` bytes, so a task never holds more
than a few dozen megabytes whatever the size of its partition.

A word's hash takes its length and then its bytes, eight at a time, each step
followed by a 64-bit finaliser; a word of more than ``LONG`` bytes is hashed
whole by BLAKE2b. Neither step is linear, so no family of words that collide is
known, and two different words share a hash with a chance of about 2**-64.
Memory is a small multiple of a slice, or of the longest text where one is
longer than a slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
#: Bytes beyond which a word is hashed by itself.
LONG = 128
_STEP = np.uint64(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The first n bytes of a little-endian 64-bit number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) in runs of rows of about ``limit`` bytes."""
    raw, at = text_buffers(column)
    first, rows = 0, len(at) - 1
    while first < rows:
        last = int(np.searchsorted(at, at[first] + limit, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def words(raw: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds): words of every row; row r has words bounds[r]:bounds[r + 1]."""
    n = len(raw)
    inside = ~space[raw]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    edges = at[(at > 0) & (at < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The 64-bit hash of each byte span."""
    sizes = ends - starts
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = _LOWER[raw] if lower else raw
    # Eight bytes from every place on, wherever it lies.
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    out = mix(sizes.astype(np.uint64) + _STEP)
    own = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    at, left, state = starts[own], sizes[own], out[own]
    while len(own):
        state = mix(state * _STEP + (eight[at] & _FIRST[np.minimum(left, 8)]))
        done = left <= 8
        out[own[done]] = state[done]
        own, at, left, state = own[~done], at[~done] + 8, left[~done] - 8, state[~done]
    for i in np.flatnonzero(sizes > LONG):
        digest = hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=8).digest()
        out[i] = np.frombuffer(digest, "<u8")[0]
    return out


def combine(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-aware hash of two hashes."""
    return mix(left * _STEP + right)
