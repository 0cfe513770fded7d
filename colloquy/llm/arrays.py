"""Numpy helpers over Arrow string batches: whole batches of texts as one byte array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: An odd base and its inverse modulo 2**64, for polynomial hashes by prefix sums.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _powers[int(base)] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows back to back and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_table(separators: bytes, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(is in a word once lowered, byte with A-Z lowered) for each of the 256 bytes."""
    inside = np.ones(256, bool)
    inside[np.frombuffer(separators, np.uint8)] = False
    low = np.arange(256, dtype=np.uint8)
    if lower:
        low[65:91] += 32
    return inside[low], low


def words(data: np.ndarray, offsets: np.ndarray, table: tuple[np.ndarray, np.ndarray], stems: tuple[int, ...] = ()):
    """Starts, ends and 64-bit hashes of all words, and each row's first word (n + 1 values); with
    ``stems``, also a list of the hashes of the words' first so many bytes.

    A row's end always ends a word, so words never run from one text into the next.
    """
    inside, low = table
    flags = np.zeros(len(data) + 1, np.int8)
    flags[:-1] = inside[data]
    edge = np.diff(flags, prepend=np.int8(0))
    begins = edge == 1
    finishes = edge == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = cut[(flags[cut] == 1) & (flags[cut - 1] == 1)]
    begins[cut] = True
    finishes[cut] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes)
    prefix = np.zeros(len(data) + 1, np.uint64)
    value = low[data].astype(np.uint64)
    value += np.uint64(1)
    value *= powers(BASE, len(data))
    np.cumsum(value, out=prefix[1:])
    hashes = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(data) + 1)[starts]
    hashes ^= (ends - starts).astype(np.uint64) << np.uint64(48)
    first = np.searchsorted(starts, offsets)
    if not stems:
        return starts, ends, mix(hashes), first
    scale = powers(INVERSE, len(data) + 1)[starts]
    cut = [mix((prefix[np.minimum(starts + k, ends)] - prefix[starts]) * scale + np.uint64(k)) for k in stems]
    return starts, ends, mix(hashes), first, cut


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs between ``starts`` and ``ends``."""
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(INVERSE, len(data) + 1)[starts] ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column from flat values and n + 1 offsets."""
    flat = pa.array(values) if kind is None else pa.array(values, kind)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)
