"""Elias-Fano codes of non-decreasing offsets, with select.

``n`` offsets up to ``top`` take about ``2 + log2(top / n)`` bits each: their low
bits are packed as they are, their high bits go to a unary bit vector in which
offset ``i`` sets bit ``high + i``. Every ``STEP``-th one's position is kept, so
that ``select`` reads a bounded stretch of the vector.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ones between two kept positions.
STEP = 256
_HEAD = struct.Struct("<QQB")


def encode(offsets: np.ndarray) -> bytes:
    """A byte string that ``EliasFano`` reads."""
    v = np.asarray(offsets, np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low_bits = max(0, (top // n).bit_length() - 1) if n else 0
    low = v & np.uint64((1 << low_bits) - 1)
    high = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(high[-1]) + 1) if n else 0, np.uint8)
    bits[high] = 1
    shifts = np.arange(low_bits, dtype=np.uint64)
    packed_low = np.packbits(((low[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    marks = high[::STEP].astype("<u4" if not n or high[-1] < 1 << 32 else "<u8")
    return b"".join(
        (_HEAD.pack(n, top, low_bits | (0x80 if marks.itemsize == 8 else 0)), marks.tobytes(), packed_low.tobytes(), np.packbits(bits, bitorder="little").tobytes())
    )


class EliasFano:
    """Reads one code; nothing but the asked stretch is unpacked by ``select``."""

    def __init__(self, code: bytes):
        self.n, self.top, flags = _HEAD.unpack_from(code)
        self.low_bits = flags & 0x7F
        n_marks = -(-self.n // STEP)
        self.marks = np.frombuffer(code, "<u8" if flags & 0x80 else "<u4", n_marks, _HEAD.size)
        at = _HEAD.size + self.marks.nbytes
        n_low = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(code, np.uint8, n_low, at)
        self.high = np.frombuffer(code, np.uint8, offset=at + n_low)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Offset ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        k, rest = divmod(i, STEP)
        start = int(self.marks[k])
        stop = int(self.marks[k + 1]) + 1 if k + 1 < len(self.marks) else len(self.high) * 8
        bits = np.unpackbits(self.high[start // 8 : -(-stop // 8)], bitorder="little")
        one = start // 8 * 8 + int(np.flatnonzero(bits[start % 8 :])[rest]) + start % 8
        low = 0
        if self.low_bits:
            at = i * self.low_bits
            part = int.from_bytes(self.low[at // 8 : -(-(at + self.low_bits) // 8)].tobytes(), "little")
            low = part >> at % 8 & ((1 << self.low_bits) - 1)
        return (one - i) << self.low_bits | low

    def all(self) -> np.ndarray:
        """All offsets."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high.astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64))
        return (high | low).astype(np.int64)
