"""Elias-Fano coding of non-decreasing integers, with select."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

_HEAD = struct.Struct("<QQB")
#: One position is kept for so many values, so that select looks at few bytes.
SAMPLE = 512
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class EliasFano:
    """``n`` values below ``bound`` in about 2 + log2(bound / n) bits each.

    The low bits of each value lie packed; the high bits are one bit string in
    which value i sets bit ``high(i) + i``. Select finds that bit from a sample.
    """

    def __init__(self, n: int, bound: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.bound, self.low_bits = n, bound, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (values[0] < 0 or (np.diff(values) < 0).any()):
            raise ValueError("values must be non-negative and non-decreasing")
        bound = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(low_bits)) & 1
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bound, low_bits, low, np.packbits(high, bitorder="little"), at[::SAMPLE].astype("<u8"))

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return _HEAD.pack(self.n, self.bound, self.low_bits) + struct.pack("<3Q", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bound, low_bits = _HEAD.unpack_from(data)
        sizes = struct.unpack_from("<3Q", data, _HEAD.size)
        ends = _HEAD.size + 24 + np.cumsum([0, *sizes])
        low, high, samples = (data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return cls(
            n, bound, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8), np.frombuffer(samples, "<u8")
        )

    def __len__(self) -> int:
        return self.n

    def _low_of(self, i: int) -> int:
        first = i * self.low_bits
        part = self.low[first >> 3 : (first + self.low_bits + 7) >> 3].tobytes()
        return (int.from_bytes(part, "little") >> (first & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """Value ``i``, from one sample and the bytes up to the next."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # ones to pass after the sampled one
        byte = at >> 3
        head = int(self.high[byte]) & (0xFF << (at & 7))
        left -= bin(head).count("1") - 1
        while left > 0:
            byte += 1
            head = int(self.high[byte])
            left -= int(_POPCOUNT[head])
        for _ in range(-left):  # step back inside the byte
            head &= ~(1 << (head.bit_length() - 1))
        return ((byte << 3) + head.bit_length() - 1 - i) << self.low_bits | self._low_of(i)

    def run(self, block: int) -> np.ndarray:
        """The values of the block of ``SAMPLE`` that starts at its sampled position.

        Only that block's bits are looked at, so that a scan by blocks is linear
        and never holds more than one block of whole numbers.
        """
        first = block * SAMPLE
        n = min(SAMPLE, self.n - first)
        if block < 0 or n <= 0:
            raise IndexError(block)
        at = int(self.samples[block])
        stop = int(self.samples[block + 1]) if block + 1 < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[at >> 3 : (stop + 7) >> 3], bitorder="little")
        ones = np.flatnonzero(bits[at & 7 :])[:n] + at
        # A block has a whole number of bytes of low bits, since SAMPLE is a multiple of 8.
        part = self.low[first * self.low_bits >> 3 : (first + n) * self.low_bits + 7 >> 3]
        bits = np.unpackbits(part, bitorder="little")[: n * self.low_bits].reshape(n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return ((ones - np.arange(first, first + n)) << self.low_bits) | low

    def runs(self) -> Iterator[np.ndarray]:
        """All values in blocks."""
        for block in range(len(self.samples)):
            yield self.run(block)

    def all(self) -> np.ndarray:
        """Every value, decoded at once."""
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1) if self.low_bits else 0
        return ((at - np.arange(self.n)) << self.low_bits) | low
