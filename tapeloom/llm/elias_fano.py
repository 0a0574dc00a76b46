"""Elias-Fano coding of monotone sequences, with vectorised access and search.

A value is split into ``low`` bits, packed, and a high part, written in unary: element i sets bit
``high + i``. Sampled positions of every 64th one and zero start a select. All arrays are flat, so a
file of them can be memory-mapped and searched without being read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
STEP = 64
#: Values searched for at once.
SLICE = 1 << 15


def _select(words: np.ndarray, samples: np.ndarray, k: np.ndarray, ones: bool) -> np.ndarray:
    """Positions of the k-th (from 0) one, or zero, for every k."""
    k = k.astype(np.int64)
    start = samples[k // STEP].astype(np.int64)
    word, rest = start >> 6, k % STEP
    flip = np.uint64(0) if ones else _FULL
    x = (words[word] ^ flip) & (_FULL << (start & 63).astype(np.uint64))
    held = np.bitwise_count(x).astype(np.int64)
    live = np.flatnonzero(held <= rest)
    while live.size:  # samples are 64 hits apart, so few words are passed
        rest[live] -= held[live]
        word[live] += 1
        x[live] = words[word[live]] ^ flip
        held[live] = np.bitwise_count(x[live])
        live = live[held[live] <= rest[live]]
    at = np.zeros(len(k), np.int64)
    for bits in (32, 16, 8, 4, 2, 1):
        mask = np.uint64((1 << bits) - 1)
        below = np.bitwise_count((x >> at.astype(np.uint64)) & mask).astype(np.int64)
        up = below <= rest
        rest -= np.where(up, below, 0)
        at += np.where(up, bits, 0)
    return (word << 6) + at


@dataclass
class EliasFano:
    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    ones: np.ndarray
    zeros: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray, top: int) -> EliasFano:
        """``values`` never fall and are at most ``top``."""
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, (int(top) // max(n, 1)).bit_length() - 1)
        high = (values >> np.uint64(low_bits)).astype(np.int64) if n else np.zeros(0, np.int64)
        size = n + (int(top) >> low_bits) + 2
        flat = np.zeros((size // 64 + 2) * 64, bool)
        at = high + np.arange(n)
        flat[at] = True
        bits = np.packbits(flat, bitorder="little").view(np.uint64)
        ones, zeros = at[::STEP], np.flatnonzero(~flat[:size])[::STEP]
        low = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            part = values & np.uint64((1 << low_bits) - 1)
            off = np.arange(n, dtype=np.int64) * low_bits
            word, shift = off >> 6, (off & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero((off & 63) + low_bits > 64)  # at most one a word
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        return cls(n, low_bits, low, bits, ones.astype(np.uint32), zeros.astype(np.uint32))

    def values(self) -> np.ndarray:
        """All elements in order."""
        at = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return (at - i).astype(np.uint64) << np.uint64(self.low_bits) | self.lows(i)

    def to_bytes(self) -> bytes:
        """A short form without samples, to be read whole by ``from_bytes``."""
        return np.array([self.n, self.low_bits, len(self.low)], np.int64).tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, size = np.frombuffer(raw, np.int64, 3).tolist()
        words = np.frombuffer(raw, np.uint64, offset=24)
        return cls(n, low_bits, words[:size], words[size:], *(np.zeros(0, np.uint32),) * 2)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        off = i * self.low_bits
        word, shift = off >> 6, (off & 63).astype(np.uint64)
        after = np.where(shift == 0, np.uint64(0), self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)))
        return ((self.low[word] >> shift) | after) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        high = (_select(self.high, self.ones, i, True) - i).astype(np.uint64)
        return high << np.uint64(self.low_bits) | self.lows(i)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element that is not below each value, and whether it equals it.

        Values are at most the ``top`` of ``build``.
        """
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        if len(values) > SLICE:  # what is worked on stays in a core's cache
            slices = [self.successor(values[k : k + SLICE]) for k in range(0, len(values), SLICE)]
            return np.concatenate([x[0] for x in slices]), np.concatenate([x[1] for x in slices])
        values = values.astype(np.uint64)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        end = _select(self.high, self.zeros, high, False) - high
        begin = np.zeros(len(high), np.int64)
        later = np.flatnonzero(high > 0)
        begin[later] = _select(self.high, self.zeros, high[later] - 1, False) - (high[later] - 1)
        want = values & np.uint64((1 << self.low_bits) - 1)
        lo, hi = begin, end.copy()
        live = np.flatnonzero(lo < hi)
        while live.size:
            middle = (lo[live] + hi[live]) >> 1
            below = self.lows(middle) < want[live]
            lo[live] = np.where(below, middle + 1, lo[live])
            hi[live] = np.where(below, hi[live], middle)
            live = live[lo[live] < hi[live]]
        same = np.zeros(len(values), bool)
        inside = np.flatnonzero(lo < end)
        same[inside] = self.lows(lo[inside]) == want[inside]
        return lo, same

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        head = np.array([self.n, self.low_bits], np.int64)
        return {f"{name}.head": head, f"{name}.low": self.low, f"{name}.high": self.high, f"{name}.ones": self.ones, f"{name}.zeros": self.zeros}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray], name: str) -> EliasFano:
        n, low_bits = (int(x) for x in arrays[f"{name}.head"])
        return cls(n, low_bits, *(arrays[f"{name}.{k}"] for k in ("low", "high", "ones", "zeros")))
