"""Vectorised helpers over Arrow text columns: flat bytes, bounded slices, words and their 64-bit hashes.

A batch is worked on in slices of bounded bytes; only a single longer document makes a larger slice.
Words are runs of bytes other than ``\\x20`` and ``\\x09-\\x0D``, A-Z lower-cased. Their identity is a 64-bit hash: with V distinct
words about V^2 / 2^65 pairs are expected to share one (less than one pair for five thousand million distinct words).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# All but letters, digits and bytes of longer characters: what stands between words when punctuation does not count.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int, kind: str = "up") -> np.ndarray:
    """The first n powers of the hash base (or of its inverse) modulo 2^64; kept for the next call unless they are many."""
    have = _powers[kind]
    if len(have) < n:
        base = np.uint64(_BASE if kind == "up" else _INVERSE)
        more = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        more[0] = 1
        have = np.multiply.accumulate(more)
        if n <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row starts; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0]:starts[-1]], starts - starts[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut so that the column has at most ``limit`` bytes in each, or one row."""
    for batch in batches:
        _, starts = flat_bytes(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * base^position up to each place, modulo 2^64."""
    out = np.empty(len(data) + 1, np.uint64)
    out[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hash of each data[start:end]."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), "down")[starts])


def words(data: np.ndarray, starts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each row (one more than rows)."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~between[data]
    begins = inside[1:-1] & ~inside[:-2]
    finish = inside[1:-1] & ~inside[2:]
    edges = starts[:-1][starts[1:] > starts[:-1]]
    begins[edges] = inside[edges + 1]
    last = starts[1:][starts[1:] > starts[:-1]] - 1
    finish[last] = inside[last + 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(finish) + 1
    return begin, end, np.searchsorted(begin, starts)


def word_hashes(data: np.ndarray, starts: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each lower-cased word, and the number of words before each row."""
    begin, end, before = words(data, starts, between)
    return span_hash(prefix_hash(LOWER[data]), begin, end), begin, end, before


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, sorted, where each is first, and each key's place among them: ``np.unique`` by one sort of plain numbers, which
    have the key's upper bits above its position; where those do not tell all keys apart, by ``np.unique`` itself."""
    n = len(keys)
    bits = max(n - 1, 0).bit_length()
    drop = 0
    if n:
        low, high = int(keys.min()), int(keys.max())
        drop = max(0, (high - low).bit_length() + bits - 64)
    if n < 2 or drop > 32:
        return np.unique(keys, return_index=True, return_inverse=True)
    mixed = (keys.view(np.uint64) - np.uint64(low % (1 << 64)) >> np.uint64(drop) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    mixed.sort()
    at = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
    ordered = keys[at]
    if drop and (ordered[1:] < ordered[:-1]).any():
        return np.unique(keys, return_index=True, return_inverse=True)
    is_first = np.empty(n, bool)
    is_first[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=is_first[1:])
    where = np.empty(n, np.int64)
    where[at] = np.cumsum(is_first) - 1
    return ordered[is_first], at[is_first], where


def ngram_hashes(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of every n words in a row of one document, and the number of n-grams before each document."""
    count = np.maximum(np.diff(before) - n + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(before[:-1], count)
    out = np.zeros(len(first), np.uint64)
    for j in range(n):
        out = mix(out + hashes[first + j] * np.uint64(2 * j + 0x5851F42D4C957F2D))
    return out, first, offsets
