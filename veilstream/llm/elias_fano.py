"""Elias-Fano coding of a non-decreasing integer sequence, with a sampled select directory."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QqBQ")
SAMPLE = 256
_ONE = np.uint64(1)


class EliasFano:
    """n values of base..base+u: low bits packed, high bits in unary; about 2 + log2(u / n) bits a value.

    Beside them stands the place of every ``SAMPLE``-th high bit that is set (an eighth of a bit a value), so
    ``select`` reads one sampled place and a few words after it; no table of 64-bit offsets exists.
    """

    def __init__(self, n: int, base: int, low_width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_width, self.low, self.high, self.samples = n, base, low_width, low, high, samples
        # whole words to read at any place
        self._low = np.concatenate([low, np.zeros(9, np.uint8)])
        self._words = np.concatenate([high, np.zeros(-len(high) % 8 + 8, np.uint8)]).view("<u8")

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        if (np.diff(values) < 0).any():
            raise ValueError("values must not decrease")
        base = int(values[0])
        x = values.view(np.uint64) - np.uint64(base & (2**64 - 1))
        low_width = max(0, (int(x[-1]) // n).bit_length() - 1)
        bits = (x[:, None] >> np.arange(low_width, dtype=np.uint64)) & _ONE if low_width else np.zeros((n, 0))
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        place = (x >> np.uint64(low_width)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(place[-1]) + 1, np.uint8)
        unary[place] = 1
        return cls(n, base, low_width, low, np.packbits(unary, bitorder="little"), place[::SAMPLE].astype(np.uint64))

    def to_bytes(self) -> bytes:
        wide = "<u4" if len(self.high) < 1 << 29 else "<u8"
        return _HEAD.pack(self.n, self.base, self.low_width, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype(wide).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, base, low_width, size = _HEAD.unpack_from(data)
        at = _HEAD.size
        low = np.frombuffer(data, np.uint8, -(-n * low_width // 8), at)
        high = np.frombuffer(data, np.uint8, size, at + len(low))
        samples = np.frombuffer(data, "<u4" if size < 1 << 29 else "<u8", -(-n // SAMPLE), at + len(low) + size)
        return cls(n, base, low_width, low, high, samples.astype(np.uint64))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_width:
            return np.zeros(len(i), np.uint64)
        at = i * self.low_width
        near = self._low[(at >> 3)[:, None] + np.arange(9)]
        shift = (at & 7).astype(np.uint64)
        x = np.ascontiguousarray(near[:, :8]).view("<u8").ravel() >> shift
        x |= np.where(shift > 0, near[:, 8].astype(np.uint64) << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
        return x & np.uint64((1 << self.low_width) - 1)

    def select(self, i):
        """The i-th value, from 0; an array of places gives an array of values."""
        alone = np.ndim(i) == 0
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        start = self.samples[i // SAMPLE].astype(np.int64)
        left, word = i % SAMPLE, start >> 6
        x = self._words[word] & (~np.uint64(0) << (start & 63).astype(np.uint64))
        ones = np.bitwise_count(x).astype(np.int64)
        while len(far := np.flatnonzero(left >= ones)):
            left[far] -= ones[far]
            word[far] += 1
            x[far] = self._words[word[far]]
            ones[far] = np.bitwise_count(x[far])
        while len(far := np.flatnonzero(left)):
            x[far] &= x[far] - _ONE
            left[far] -= 1
        place = word * 64 + np.bitwise_count((x & (~x + _ONE)) - _ONE)
        high = (place - i).astype(np.uint64) << np.uint64(self.low_width)
        out = ((high | self._lows(i)) + np.uint64(self.base & (2**64 - 1))).view(np.int64)
        return int(out[0]) if alone else out

    def values(self) -> np.ndarray:
        """All values, decoded in order."""
        if not self.n:
            return np.zeros(0, np.int64)
        x = (np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_width)
        return ((x | self._lows(np.arange(self.n))) + np.uint64(self.base & (2**64 - 1))).view(np.int64)
