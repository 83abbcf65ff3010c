"""Elias-Fano sequences in numpy: sorted integers in about 2 + log2(universe / n) bits each, searched without unpacking.

The low bits of every value are packed side by side; the high bits are a unary bit vector with one count for every word
of 64 bits. All lookups work on arrays of queries.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_POPCOUNT = np.bitwise_count(np.arange(256, dtype=np.uint8))
# The place of the k-th set bit in each byte value.
_PLACES = np.array([[next((b for b in range(8) if v >> b & 1 and bin(v & ((1 << b) - 1)).count("1") == k), 8) for k in range(8)] for v in range(256)], np.uint8)


class EliasFano:
    """`parts()` are plain arrays that may lie in a mapped file; `EliasFano(*parts)` searches them."""

    def __init__(self, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.sizes, self.low, self.high, self.ones = sizes, low, high, ones
        self.n, self.bits, self.buckets = (int(x) for x in sizes)
        self.windows = np.ndarray((len(low) - 7,), "<u8", low, strides=(1,))
        self.mask = _U((1 << self.bits) - 1)
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @staticmethod
    def parts(values: np.ndarray) -> list[np.ndarray]:
        """The arrays for rising (or equal) 64-bit integers."""
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = min(56, max(0, (top // max(n, 1)).bit_length() - 1))
        packed = []
        for at in range(0, n, 1 << 16):
            part = (values[at : at + (1 << 16)] & _U((1 << bits) - 1)).astype("<u8")
            flat = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :bits]
            packed.append(np.packbits(flat.reshape(-1), bitorder="little"))
        low = np.concatenate([*packed, np.zeros(16, np.uint8)])
        buckets = (top - 1 >> bits) + 1
        length = -(-(n + buckets + 1) // 64) * 64
        flags = np.zeros(length, bool)
        flags[(values >> _U(bits)).astype(np.int64) + np.arange(n)] = True
        high = np.packbits(flags, bitorder="little")
        ones = np.append(0, np.cumsum(_POPCOUNT[high].reshape(-1, 8).sum(axis=1, dtype=np.int64)))
        return [np.array([n, bits, buckets]), low, high, ones]

    def _select(self, k: np.ndarray, counts: np.ndarray, flip: int) -> np.ndarray:
        """Bit positions of the k-th one (or zero, where flip is 255)."""
        word = np.searchsorted(counts, k, "right") - 1
        rest = k - counts[word]
        byte = word * 8
        for _ in range(7):
            here = _POPCOUNT[self.high[byte] ^ flip]
            on = rest >= here
            # Words are left as soon as the wanted bit lies in the current byte.
            rest = np.where(on, rest - here, rest)
            byte = np.where(on, byte + 1, byte)
            if not on.any():
                break
        return byte * 8 + _PLACES[self.high[byte] ^ flip, rest]

    def get(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        low = (self.windows[at >> 3] >> (at & 7).astype(_U)) & self.mask
        return ((self._select(i, self.ones, 0) - i).astype(_U) << _U(self.bits)) | low

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first value that is at least x (n if there is none), and whether it is x."""
        top = x >> _U(self.bits)
        beyond = top >= _U(self.buckets)
        top = np.minimum(top, _U(self.buckets - 1)).astype(np.int64)
        start = np.where(top > 0, self._select(np.maximum(top - 1, 0), self.zeros, 255) - np.maximum(top - 1, 0), 0)
        stop = self._select(top, self.zeros, 255) - top
        start, stop = np.where(beyond, self.n, start), np.where(beyond, self.n, stop)
        want = x & self.mask
        found = np.zeros(len(x), bool)
        open_ = np.flatnonzero(start < stop)
        while len(open_):
            at = start[open_] * self.bits
            low = (self.windows[at >> 3] >> (at & 7).astype(_U)) & self.mask
            found[open_] = low == want[open_]
            less = open_[low < want[open_]]
            start[less] += 1
            open_ = less[start[less] < stop[less]]
        return start, found
