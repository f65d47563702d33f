"""Vectorised text kernels shared by the operators.

All of them work on one Arrow batch: the UTF-8 bytes of the texts as one
``uint8`` array plus the offsets of the texts in it.  No per-word Python
objects are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64

#: Bytes of text that one call of a kernel handles; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: A random 64-bit value for each byte, fixed by the seed.
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240117)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes."""
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text and the number of words) of the maximal runs of bytes that aren't in ``breaks``."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(breaks[data], out=inside[1:-1])
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of byte value times power."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(_BYTE_VALUES[data], _power(_BASE, n) if n else 1, out=sums[1:])
    np.cumsum(sums, out=sums)
    own = (sums[end] - sums[start]) * _power(_INVERSE, n + 1)[start]
    return mix(own + (end - start).astype(np.uint64) * U64(0xD6E8FEB86659FD93))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` words, whatever texts they belong to; n - length + 1 of them."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(length):
        total *= U64(0x2545F4914F6CDD1D)
        total += words[k : k + n]
    return mix(total)


def window_starts(first: np.ndarray, length: int) -> np.ndarray:
    """The word numbers at which a window of ``length`` words of one text starts. first: n + 1 bounds of the texts' words."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int32)
    counts = np.diff(first)
    full = counts >= length
    np.add.at(ok, first[:-1][full], 1)
    np.add.at(ok, first[1:][full] - length + 1, -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0)


def cover(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in a run of ``length`` from one of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:n]) > 0
