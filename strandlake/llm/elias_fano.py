"""Elias-Fano code of a rising sequence, with a directory for select.

A sequence of n numbers up to u is split at l = log2(u / n) bits: low halves stand packed, l bits each; of the high halves
the i-th sets bit high + i of a bit string, which has n ones and u >> l zeros. The i-th number is then select(i) - i, shifted,
plus its low half. Together about 2 + log2(u / n) bits a number. The directory holds where every STEP-th one stands, in 32
bits, so select looks at one stretch of the bit string.
"""

from __future__ import annotations

import struct

import numpy as np

#: A place in the directory for so many numbers: 32 / 256 bits a number.
STEP = 256
_HEAD = struct.Struct("<qQBI")


def encode(values: np.ndarray) -> bytes:
    """values: int64, none below the one before it. They may be negative, equal, and as far apart as int64 allows."""
    values = np.asarray(values, np.int64)
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0, 0)
    if (values[1:] < values[:-1]).any():
        raise ValueError("the values must not fall")
    away = values.astype(np.uint64) - values[:1].astype(np.uint64)  # modulo 2^64: right for any two int64
    low = max(0, (int(away[-1]) // n).bit_length() - 1)
    lows = b""
    if low:
        bits = (away[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    places = (away >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(places[-1]) // 8 + 1, np.uint8)
    np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
    return _HEAD.pack(int(values[0]), n, low, len(high)) + places[::STEP].astype("<u4").tobytes() + high.tobytes() + lows


class EliasFano:
    """Reads what encode() made: len(), select(i) for one place or an array of places, and all()."""

    def __init__(self, data: bytes):
        self.first, self.n, self.low, size = _HEAD.unpack_from(data)
        at, marks = _HEAD.size, -(-self.n // STEP)
        self.marks = np.frombuffer(data, "<u4", marks, at).astype(np.int64)
        self.high = np.frombuffer(data, np.uint8, size, at + 4 * marks)
        self.lows = np.frombuffer(data, np.uint8, -1, at + 4 * marks + size)

    def __len__(self) -> int:
        return self.n

    def _values(self, places: np.ndarray, order: np.ndarray) -> np.ndarray:
        away = (places - order).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bit = order[:, None] * self.low + np.arange(self.low)
            bits = self.lows[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            away |= (bits.astype(np.uint64) << np.arange(self.low, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return (away + np.array([self.first]).astype(np.uint64)).astype(np.int64)

    def select(self, i):
        """The i-th value, from 0 on; of an array of places, the array of values."""
        order = np.atleast_1d(np.asarray(i, np.int64))
        if len(order) and (order.min() < 0 or order.max() >= self.n):
            raise IndexError(i)
        places = np.empty(len(order), np.int64)
        for block in np.unique(order // STEP):
            here = order // STEP == block
            start = int(self.marks[block]) >> 3
            end = (int(self.marks[block + 1]) >> 3) + 1 if block + 1 < len(self.marks) else len(self.high)
            ones = np.flatnonzero(np.unpackbits(self.high[start:end], bitorder="little")) + 8 * start
            ones = ones[np.searchsorted(ones, self.marks[block]) :]
            places[here] = ones[order[here] - block * STEP]
        values = self._values(places, order)
        return int(values[0]) if np.ndim(i) == 0 else values

    def all(self) -> np.ndarray:
        if not self.n:
            return np.empty(0, np.int64)
        return self._values(np.flatnonzero(np.unpackbits(self.high, bitorder="little")), np.arange(self.n))
