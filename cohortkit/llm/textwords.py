"""Vectorised words and shingles of many texts at once (numpy, inside tasks).

A word is a maximal run of bytes other than space and \\t \\n \\v \\f \\r;
A-Z are lower-cased.  Words are identified by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer text is handled alone.
BLOCK_BYTES = 1 << 21
_P = 0x9E3779B97F4A7C15 | 1


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


SPACES = byte_table(b" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Hasher:
    """Hashes byte ranges of a buffer from prefix sums of a polynomial."""

    def __init__(self) -> None:
        self.values = _byte_values()
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        p = np.full(n + 1, _P, dtype=U64)
        p[0] = 1
        self.power = np.cumprod(p)
        p[1:] = pow(_P, -1, 1 << 64)
        self.inverse = np.cumprod(p)

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if n > len(self.power) - 1:
            self.grow(2 * n)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(self.values[data] * self.power[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(h ^ (ends - starts).astype(U64))


def blocks(texts: pa.Array):
    """Yield (first row, bytes, offsets) for runs of whole texts of about BLOCK_BYTES."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK_BYTES, side="right")) - 1)
        yield i, data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        i = j


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    n = len(member)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inner = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    before[inner] = False
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    after[inner - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def word_hashes(hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and the first word's index of each text (one more at the end)."""
    starts, ends = runs(~SPACES[data], offsets)
    return hasher.ranges(LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, width: int, hasher: Hasher):
    """Yield for each text its sorted distinct shingle hashes.

    A text with fewer than ``width`` words has its whole word sequence as its
    one shingle; a text without words has none.
    """
    factors = mix(np.arange(1, width + 1, dtype=U64)) | U64(1)  # unrelated, so that no two orders of words agree
    for _, data, offsets in blocks(texts):
        words, first = word_hashes(hasher, data, offsets)
        n = len(words)
        if n >= width:
            rolled = np.zeros(n - width + 1, dtype=U64)
            for k, f in enumerate(factors):
                rolled += words[k:n - width + 1 + k] * f
            rolled = mix(rolled)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(rolled[a:b - width + 1])
            elif b > a:
                whole = (words[a:b] * factors[:b - a]).sum(dtype=U64, keepdims=True)
                yield mix(mix(whole) + U64(b - a))
            else:
                yield np.zeros(0, dtype=U64)
