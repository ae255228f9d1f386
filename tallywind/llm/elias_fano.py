"""Monotone sequences in Elias-Fano form, as flat arrays that can be memory-mapped; all look-ups are vectorised."""

from __future__ import annotations

import json

import numpy as np

from . import files

_BIT = np.zeros((256, 8), np.uint8)  # place of the k-th set bit of a byte
for _b in range(256):
    for _k, _p in enumerate([p for p in range(8) if _b >> p & 1]):
        _BIT[_b, _k] = _p
_ODD, _PAIRS, _HALVES, _ONES, _TOPS = (np.uint64(x * 0x0101010101010101) for x in (0x55, 0x33, 0x0F, 0x01, 0x80))
_1, _2, _4, _8, _BYTE = (np.uint64(x) for x in (1, 2, 4, 8, 255))


def bit_place(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th set bit (from 0) of each word, which has more than k."""
    k = k.astype(np.uint64)
    upto = words - (words >> _1 & _ODD)
    upto = (upto & _PAIRS) + (upto >> _2 & _PAIRS)
    upto = (upto + (upto >> _4) & _HALVES) * _ONES  # in each byte: the set bits up to its end
    shift = np.bitwise_count((k * _ONES | _TOPS) - upto & _TOPS).astype(np.uint64) << np.uint64(3)  # bytes that end before the bit
    left = k - (upto << _8 >> shift & _BYTE)
    return (shift + _BIT.ravel()[(words >> shift & _BYTE) << np.uint64(3) | left]).astype(np.int64)


def write_arrays(path: str, head: dict, arrays: dict[str, np.ndarray]) -> None:
    """A line of JSON, padded to 8 bytes, then the arrays, each padded to 8 bytes (8 more after the last, for unaligned reads)."""
    layout, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        layout[name] = [a.dtype.str, len(a), at]
        raw += b"\0" * (-len(raw) % 8)
        parts.append(raw)
        at += len(raw)
    line = json.dumps({"head": head, "arrays": layout}).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    files.write_bytes(path, line, *parts, b"\0" * 8)


def open_arrays(path: str) -> tuple[dict, dict[str, np.ndarray]]:
    """The header and mapped views of the arrays of a file."""
    raw = files.memory_map(path, np.uint8)
    end, step = -1, 1 << 16
    while end < 0:
        found = np.flatnonzero(raw[:step] == 10)
        end, step = (int(found[0]) + 1 if len(found) else -1), step * 4
    spec = json.loads(raw[:end].tobytes())
    views = {name: raw[end + at:end + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, n, at) in spec["arrays"].items()}
    for name, (kind, n, at) in spec["arrays"].items():
        if name.endswith(".low"):  # read eight bytes at any place
            views[name] = raw[end + at:end + at + n + 8]
    return spec["head"], views


class EliasFano:
    """Sorted non-negative integers below ``universe``: the low bits packed, the high bits in unary with counts of zeros per word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros = n, low_bits, low, high, zeros
        self.words = np.ndarray((max(len(low) - 7, 0),), "<u8", low, strides=(1,)) if len(low) >= 8 else np.zeros(0, "<u8")

    @staticmethod
    def encode(values: np.ndarray, universe: int) -> tuple[dict, dict[str, np.ndarray]]:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        bits = min(bits, 56)
        low = values.astype(np.uint64) & np.uint64((1 << bits) - 1)
        parts = []
        for at in range(0, n, 1 << 18):  # a multiple of eight values, so the parts end on whole bytes
            block = low[at:at + (1 << 18)]
            parts.append(np.packbits((block[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        packed = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        top = (values.astype(np.uint64) >> np.uint64(bits)).astype(np.int64)
        unary = np.zeros((n + (universe >> bits) + 2 + 63) // 64 * 64, np.uint8)
        unary[top + np.arange(n)] = 1
        high = np.packbits(unary, bitorder="little").view("<u8")
        zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))]).astype("<u4")
        return {"n": n, "bits": bits}, {"low": packed, "high": high, "zeros": zeros}

    @classmethod
    def opened(cls, head: dict, views: dict, name: str) -> "EliasFano":
        return cls(head[name]["n"], head[name]["bits"], views[f"{name}.low"], views[f"{name}.high"], views[f"{name}.zeros"])

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits or not len(i):
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.low_bits
        return self.words[at >> 3] >> (at & 7).astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + bit_place(~self.high[word], k - self.zeros[word].astype(np.int64))

    def rank(self, x: np.ndarray) -> np.ndarray:
        """How many values are smaller than each x: the place where x, or its successor, stands."""
        x = np.asarray(x, np.int64)
        top = x >> self.low_bits
        start = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1 - top, 0)
        end = self._zero(top) - top
        want = x.astype(np.uint64) & np.uint64((1 << self.low_bits) - 1)
        low, high = start.copy(), end.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = self.lows(middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        return low

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each x and whether it is there."""
        i = self.rank(x)
        ok = i < self.n
        ok[ok] = self.access(i[ok]) == np.asarray(x, np.int64)[ok]
        return i, ok

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        ones = np.arange(len(self.zeros), dtype=np.int64) * 64 - self.zeros if not hasattr(self, "_ones") else self._ones
        self._ones = ones
        word = np.searchsorted(ones, i, "right") - 1
        at = word * 64 + bit_place(self.high[word], i - ones[word])
        return ((at - i) << self.low_bits) + self.lows(i).astype(np.int64)

    def values(self) -> np.ndarray:
        """All values, in order."""
        places = np.flatnonzero(np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little"))
        i = np.arange(self.n, dtype=np.int64)
        return ((places - i) << self.low_bits) + self.lows(i).astype(np.int64)
