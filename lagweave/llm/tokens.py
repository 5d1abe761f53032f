"""White-space separated words of Arrow columns as 64-bit hashes, by whole-array steps instead of a loop over words.

A word's hash is a polynomial over its bytes (A-Z as a-z), each byte standing for a 64-bit number of its own, mixed at
the end. Powers of an odd base have inverses, so running sums over a piece of text give every word's hash at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
#: Bytes hashed at once, which bounds memory.
PIECE = 1 << 18
BASE = xxhash.xxh64_intdigest(b"base") | 1
VALUES = np.array([xxhash.xxh64_intdigest(bytes([b + 32 if 65 <= b <= 90 else b])) for b in range(256)], U)
#: The same with capitals told apart.
EXACT = np.array([xxhash.xxh64_intdigest(bytes([b])) for b in range(256)], U)
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % (1 << 64), U)
    out[0] = 1
    return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, PIECE + 1), powers(pow(BASE, -1, 1 << 64), PIECE + 1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of h over the whole word."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def long_word(raw: np.ndarray, values: np.ndarray = VALUES) -> int:
    """The polynomial of a word longer than a piece."""
    total, factor, step = 0, 1, int(UP[PIECE - 1]) * BASE % (1 << 64)
    for i in range(0, len(raw), PIECE):
        part = values[raw[i : i + PIECE]]
        total = (total + factor * int((part * UP[: len(part)]).sum(dtype=U))) % (1 << 64)
        factor = factor * step % (1 << 64)
    return total


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """The hashes of the words raw[start:end], which do not overlap and are in order."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        if int(ends[j - 1]) - begin > PIECE:
            out[i] = long_word(raw[begin : int(ends[i])], values)
        else:
            part = values[raw[begin : int(ends[j - 1])]]
            sums = np.concatenate([np.zeros(1, U), np.cumsum(part * UP[: len(part)], dtype=U)])
            a, b = starts[i:j] - begin, ends[i:j] - begin
            out[i:j] = (sums[b] - sums[a]) * DOWN[a]
        i = j
    return mixed(out)


def hash_word(word: bytes) -> int:
    return int(hash_spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at


def blocks(column: pa.Array, block_bytes: int, first: int, last: int, values: np.ndarray = VALUES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, tokens, starts) for rows i..j-1 of about block_bytes together: first, the words' hashes, last of every
    row, and the row's place in tokens (starts has one more entry)."""
    data, at = buffers(column)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + block_bytes, "right")) - 1)
        raw, edge = data[at[i] : at[j]], at[i : j + 1] - at[i]
        word = ~BLANK[raw]
        before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
        before[1:], after[:-1] = ~word[:-1], ~word[1:]
        full = edge[:-1] < edge[1:]
        before[edge[:-1][full]] = True
        after[edge[1:][full] - 1] = True
        s, e = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
        upto = np.searchsorted(s, edge)
        starts = upto + 2 * np.arange(len(upto))
        out = np.empty(starts[-1], U)
        out[np.arange(len(s)) + 2 * np.repeat(np.arange(j - i), np.diff(upto)) + 1] = hash_spans(raw, s, e, values)
        out[starts[:-1]], out[starts[1:] - 1] = first, last
        yield i, j, out, starts
        i = j
