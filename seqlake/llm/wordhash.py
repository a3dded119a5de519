"""Vectorised word and window hashes over Arrow string arrays, alike on every worker and run."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Texts are hashed in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit words."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_table(lower: bool) -> np.ndarray:
    code = np.arange(256, dtype=np.uint64)
    if lower:
        code[65:91] += np.uint64(32)
    t = mix(code * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))
    t[SPACE] = 0
    return t


TABLE = {lower: _byte_table(lower) for lower in (False, True)}
BYTES = {lower: np.arange(256, dtype=np.uint8) for lower in (False, True)}
BYTES[True][65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of BASE and of its inverse for so many bytes are kept.
BLOCK = 1 << 18
UP, DOWN = powers(BASE, BLOCK), powers(np.uint64(pow(int(BASE), -1, 1 << 64)), BLOCK)


class Words:
    """Words of a run of texts: hash, first byte and end byte of each; text i has words first[i]:first[i+1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data, self.offsets, self.lower = data, offsets, lower
        solid = ~SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        start = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.start = start
        self.first = np.searchsorted(start, offsets)

    @cached_property
    def hash(self) -> np.ndarray:
        return mix(self._sums(TABLE[self.lower][self.data]) + (self.end - self.start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def strings(self) -> pa.Array:
        """The words themselves, one after the other; A-Z lowered if the hashes are."""
        raw = BYTES[self.lower][self.data[~SPACE[self.data]]]
        ends = np.concatenate([[0], np.cumsum(self.end - self.start)]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(self.start), [None, pa.py_buffer(ends), pa.py_buffer(raw)])

    def _sums(self, codes: np.ndarray) -> np.ndarray:
        """For each word the sum of code * BASE**place over its bytes: differences of running sums, shifted back."""
        out = np.zeros(len(self.start), dtype=np.uint64)
        a = 0
        while a < len(self.start):  # blocks of whole words bound the tables of powers; a longer word is a block of its own
            first = self.start[a]
            b = max(a + 1, int(np.searchsorted(self.end, first + BLOCK, side="right")))
            n = int(self.end[b - 1] - first)
            up, down = (UP[:n], DOWN) if n <= BLOCK else (powers(BASE, n), DOWN)
            run = np.zeros(n + 1, dtype=np.uint64)
            np.add.accumulate(codes[first : first + n] * up, out=run[1:])
            # the only word of a longer block starts at 0
            out[a:b] = (run[self.end[a:b] - first] - run[self.start[a:b] - first]) * down[self.start[a:b] - first]
            a = b
        return out

    def windows(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of each run of k consecutive words, crossing texts too: callers keep starts up to first[i+1]-k."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        h = self.hash if not salt else mix(self.hash ^ np.uint64(salt))
        p = powers(BASE, len(h))
        back = powers(np.uint64(pow(int(BASE), -1, 1 << 64)), n)
        sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.add.accumulate(h * p, out=sums[1:])
        return mix((sums[k:] - sums[:n]) * back)


def slices(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over consecutive rows; null has no words."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
        j = min(j, n)
        yield i, j, Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower)
        i = j
