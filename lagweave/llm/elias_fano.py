"""Elias-Fano coding of monotone sequences of unsigned 64-bit numbers, with vectorised access and successor search.

The low bits of every value are packed; the high parts are gaps in unary in a bit vector, with the number of ones
before each block of 512 bits. All arrays may be memory-mapped.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
ONE, WORD = U(1), U(64)


def packed(values: np.ndarray, width: int) -> np.ndarray:
    """width bits of each value, one after the other, in 64-bit words (and a spare one)."""
    out = np.zeros(len(values) * width // 64 + 2, "<u8")
    step = 1 << 15  # a multiple of 64 values ends on a whole word
    for i in range(0, len(values) if width else 0, step):
        bits = np.unpackbits(values[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=width)
        raw = np.packbits(bits.ravel(), bitorder="little")
        at = i * width // 8
        out.view(np.uint8)[at : at + len(raw)] = raw
    return out


def unpacked(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U)
    bit = i.astype(U) * U(width)
    w, off = (bit >> U(6)).astype(np.int64), bit & U(63)
    low = words[w] >> off
    high = np.where(off > 0, words[w + 1] << ((WORD - off) & U(63)), U(0))
    return (low | high) & U((1 << width) - 1)


def encode(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
    """values: sorted; universe: an upper bound (exclusive)."""
    n = len(values)
    width = max(0, (universe // max(n, 1)).bit_length() - 1)
    size = ((universe - 1) >> width) + n + 2 if universe else n + 2
    bits = np.zeros(-(-size // 512) * 512 + 512, np.uint8)
    if n:
        bits[(values >> U(width)).astype(np.int64) + np.arange(n)] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(bits.reshape(-1, 512).sum(1, dtype=np.int64))]).astype("<i8")
    return {"low": packed(values & U((1 << width) - 1) if width else values, width), "high": high, "ones": ones, "shape": np.array([n, width], "<i8")}


def repeated(byte: int) -> np.uint64:
    return U(byte * 0x0101010101010101)


#: SELECT[byte, k]: the place of a byte's k-th bit that is 1.
SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], U)


def select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of each word's k-th (from 0) bit that is 1; it has so many."""
    n = word - ((word >> ONE) & repeated(0x55))
    n = (n & repeated(0x33)) + ((n >> U(2)) & repeated(0x33))
    n = ((n + (n >> U(4))) & repeated(0x0F)) * repeated(1)  # in each byte the ones up to its end
    k = k.astype(U)
    at = np.bitwise_count((((k * repeated(1)) | repeated(0x80)) - n) & repeated(0x80)).astype(U) << U(3)
    rest = k - (((n << U(8)) >> at) & U(255))
    return (at + SELECT[((word >> at) & U(255)).astype(np.int64), rest.astype(np.int64)]).astype(np.int64)


class EliasFano:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.low, self.high, self.ones = arrays["low"], arrays["high"], arrays["ones"]
        self.n, self.width = map(int, arrays["shape"])
        self.zeros = np.arange(len(self.ones)) * 512 - self.ones
        self.before: dict[bool, np.ndarray] = {}  # ones or zeros before each word, where they were counted

    def _words_before(self, one: bool) -> np.ndarray:
        if one not in self.before:
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
            self.before = {True: ones, False: np.arange(len(ones)) * 64 - ones}
        return self.before[one]

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th (from 0) bit that is 1, or 0."""
        if isinstance(self.high, np.ndarray) and (self.before or 8 * len(k) >= len(self.high)):
            before = self._words_before(one)  # many places of an array at hand: its words are counted once
            j = np.searchsorted(before, k, "right") - 1
            word = self.high[j]
            return j * 64 + select_in_word(word if one else ~word, k - before[j])
        block = np.searchsorted(self.ones if one else self.zeros, k, "right") - 1
        rest = k - (self.ones if one else self.zeros)[block]
        words = self.high[block[:, None] * 8 + np.arange(8)]
        words = words if one else ~words
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        j = (upto <= rest[:, None]).sum(1)
        row = np.arange(len(k))
        rest = rest - np.where(j > 0, upto[row, j - 1], 0)
        return block * 512 + j * 64 + select_in_word(words[row, j], rest)

    def _next_zero(self, at: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The place of the k-th bit that is 0, the first one from place at."""
        left = ~self.high[at >> 6] >> (at & 63).astype(U)
        out = at + np.bitwise_count((left & (~left + ONE)) - ONE)
        far = np.flatnonzero(left == 0)
        out[far] = self._select(k[far], False)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.empty(0, U)
        return ((self._select(i, True) - i).astype(U) << U(self.width)) | unpacked(self.low, self.width, i)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the first value >= x (n if none), and whether it equals x."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64) + self.n, np.zeros(len(x), bool)
        high = (x >> U(self.width)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        high = np.clip(high, 0, last)  # beyond the last value there are zeros only
        begin = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) + 1, 0)
        lo = begin - high
        hi = end = self._next_zero(begin, high) - high
        lo, hi = np.clip(lo, 0, self.n), np.clip(hi, 0, self.n)
        want, end = x & U((1 << self.width) - 1), hi.copy()
        active = np.flatnonzero(lo < hi)
        while len(active):  # among the values of equal high part
            mid = (lo[active] + hi[active]) // 2
            less = unpacked(self.low, self.width, mid) < want[active]
            lo[active] = np.where(less, mid + 1, lo[active])
            hi[active] = np.where(less, hi[active], mid)
            active = active[lo[active] < hi[active]]
        equal = lo < end
        equal[equal] = unpacked(self.low, self.width, lo[equal]) == want[equal]
        return lo, equal
