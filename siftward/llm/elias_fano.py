"""Elias-Fano code of a rising sequence, with select: near-minimal space, no table of 64-bit offsets.

Of each value the low bits are stored as they are. The high parts are stored in unary, one
1 bit for each value at place ``high + index``; select finds the k-th 1.
"""

from __future__ import annotations

import struct

import numpy as np

#: One sampled position for so many values.
STRIDE = 512
HEADER = struct.Struct("<QQqBQ")


class EliasFano:
    """Rising values of any sign, repeats allowed."""

    def __init__(self, n: int, least: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.least, self.low_bits = n, least, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        least = int(values[0]) if n else 0
        rest = values.view(np.uint64) - np.array(least, np.int64).view(np.uint64)
        span = int(rest[-1]) + 1 if n else 1
        low_bits = max(0, (span // max(n, 1)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((rest[:, None] >> shifts) & np.uint64(1)).astype(np.uint8), bitorder="little")
        places = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, least, low_bits, low, np.packbits(bits, bitorder="little"), places[::STRIDE].astype("<u4"))

    def select_range(self, start: int, stop: int) -> np.ndarray:
        """Values ``start`` to ``stop`` - 1: reads the high bits from the sample before ``start``."""
        if stop <= start:
            return np.zeros(0, np.int64)
        block = start // STRIDE
        first = int(self.samples[block])
        after = -(-stop // STRIDE)
        last = int(self.samples[after]) if after < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[first // 8 : last // 8 + 1], bitorder="little")
        ones = np.flatnonzero(bits[first % 8 :]) + first
        ones = ones[start - block * STRIDE : stop - block * STRIDE]
        high = (ones - np.arange(start, stop)).astype(np.uint64)
        a, b = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        low = (bits.reshape(stop - start, self.low_bits).astype(np.uint64) * weights).sum(1, dtype=np.uint64)
        base = np.array(self.least, np.int64).view(np.uint64)
        return ((high << np.uint64(self.low_bits) | low) + base).view(np.int64)

    def select(self, k: int) -> int:
        return int(self.select_range(k, k + 1)[0])

    def to_bytes(self) -> bytes:
        head = HEADER.pack(self.n, len(self.high), self.least, self.low_bits, len(self.low))
        return b"".join([head, self.samples.tobytes(), self.high.tobytes(), self.low.tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, n_high, least, low_bits, n_low = HEADER.unpack_from(data)
        at, n_samples = HEADER.size, -(-n // STRIDE)
        samples = np.frombuffer(data, "<u4", n_samples, at)
        high = np.frombuffer(data, np.uint8, n_high, at + 4 * n_samples)
        low = np.frombuffer(data, np.uint8, n_low, at + 4 * n_samples + n_high)
        return cls(n, least, low_bits, low, high, samples)
