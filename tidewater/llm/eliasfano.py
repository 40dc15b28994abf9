"""Elias-Fano coded monotone sequences, with vectorised access and successor search over memory-mapped words; also as messages."""

from __future__ import annotations

import struct

import numpy as np

#: Of a packed sequence: how many numbers, and their low bits.
_HEAD = struct.Struct("<IB")

_POP = np.array([bin(x).count("1") for x in range(256)], np.uint8)
_SELECT = np.full((256, 8), 8, np.uint8)
for _x in range(256):
    _at = [k for k in range(8) if _x >> k & 1]
    _SELECT[_x, : len(_at)] = _at


class Bits:
    """A bit vector as bytes; the counts before each byte, for select, are made when it is opened."""

    def __init__(self, data: np.ndarray):
        self.data = data
        ones = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_POP[data], out=ones[1:])
        self.ones_before = ones
        self.zeros_before = np.arange(len(ones), dtype=np.int64) * 8 - ones

    @classmethod
    def of(cls, positions: np.ndarray, length: int) -> Bits:
        flat = np.zeros((length // 64 + 1) * 64, np.uint8)
        flat[positions] = 1
        return cls(np.packbits(flat, bitorder="little"))

    def select(self, k: np.ndarray, zeros: bool = False) -> np.ndarray:
        """Position of the k-th (from 0) one or zero."""
        before = self.zeros_before if zeros else self.ones_before
        byte = np.searchsorted(before, k, "right") - 1
        values = self.data[byte]
        return byte * 8 + _SELECT[~values if zeros else values, k - before[byte]]


class EliasFano:
    """n non-decreasing numbers below a universe: low bits packed, high parts in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: Bits):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.int64)
        n = len(values)
        bits = max(0, (universe // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits and n:
            lows = (values & ((1 << bits) - 1)).astype(np.uint64)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            low[word[starts]] = np.bitwise_or.reduceat(lows << shift, starts)
            over = np.flatnonzero((at & 63) + bits > 64)
            low[word[over] + 1] |= lows[over] >> (np.uint64(64) - shift[over])
        highs = values >> bits
        high = Bits.of(highs + np.arange(n), n + (universe >> bits) + 2)
        return cls(n, bits, low, high)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.int64)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = (at & 63) + self.low_bits > 64
        out = np.where(over, out | self.low[word + 1] << (np.uint64(64) - np.maximum(shift, np.uint64(1))), out)
        return (out & np.uint64((1 << self.low_bits) - 1)).astype(np.int64)

    def access(self, i: np.ndarray) -> np.ndarray:
        return (self.high.select(i) - i) << self.low_bits | self._low(i)

    def find(self, x: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of x, or -1: its successor among the numbers before ``end``, if that equals it.

        The zeros around a high part bound its numbers, whose low bits are searched by halving.
        """
        high = x >> self.low_bits
        low = x & ((1 << self.low_bits) - 1)
        at = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(high > 0)
        at[inner] = self.high.select(high[inner] - 1, zeros=True) - high[inner] + 1
        stop = np.minimum(end, self.high.select(high, zeros=True) - high)
        out = np.full(len(x), -1, np.int64)
        todo = np.flatnonzero(at < stop)
        at, stop, low = at[todo], stop[todo], low[todo]
        while len(todo):
            middle = (at + stop) >> 1
            seen = self._low(middle)
            hit = seen == low
            out[todo[hit]] = middle[hit]
            below = seen < low
            at, stop = np.where(below, middle + 1, at), np.where(below, stop, middle)
            on = np.flatnonzero(~hit & (at < stop))
            todo, at, stop, low = todo[on], at[on], stop[on], low[on]
        return out

    def values(self) -> np.ndarray:
        at = np.arange(self.n, dtype=np.int64)
        return (np.flatnonzero(np.unpackbits(self.high.data, bitorder="little")) - at) << self.low_bits | self._low(at)

    def packed(self) -> bytes:
        """The sequence as a message, without the bytes that only fill up words."""
        return _HEAD.pack(self.n, self.low_bits) + self.low.tobytes()[: (self.n * self.low_bits + 7) // 8] + self.high.data.tobytes().rstrip(b"\0")

    @classmethod
    def unpacked(cls, data: bytes) -> EliasFano:
        n, low_bits = _HEAD.unpack_from(data)
        size = (n * low_bits + 7) // 8
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        low.view(np.uint8)[:size] = np.frombuffer(data, np.uint8, size, _HEAD.size)
        return cls(n, low_bits, low, Bits(np.frombuffer(data, np.uint8, offset=_HEAD.size + size)))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.int64), self.low, self.high.data]

    @classmethod
    def from_arrays(cls, head: np.ndarray, low: np.ndarray, high: np.ndarray) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, Bits(high))
