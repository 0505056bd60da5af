"""Rolling hashes over batches of UTF-8 texts, in numpy.

Every function works on a *chunk*: the bytes of some whole documents, one after
the other, and the offsets where each begins. Hashes are polynomials modulo
2**64 over random 64-bit codes of the bytes (or words), so the hash of any
stretch comes from two prefix sums, wherever the stretch lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.Generator(np.random.PCG64(20240229))
_CODES = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = _CODES.copy()
_LOWER[ord("A") : ord("Z") + 1] = _CODES[ord("a") : ord("z") + 1]
_BASE = 0x9E3779B97F4A7C15 & ~7 | 5
_WORD_BASE = 0xC2B2AE3D27D4EB4F & ~7 | 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words without punctuation: every ASCII character but letters and digits.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

#: Bytes of text that one chunk holds, unless a single document is longer.
CHUNK_BYTES = 1 << 19


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (self._powers(b, n) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts (or of their bytes); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of each chunk."""
    data, at = text_buffer(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


class Sums:
    """Prefix sums from which the hash of any stretch is taken."""

    def __init__(self, codes: np.ndarray, powers: _Powers):
        up, self.down = powers.get(len(codes) + 1)
        self.total = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[:-1], out=self.total[1:])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * self.down[start]

    def windows(self, n: int) -> np.ndarray:
        """Of each ``n`` consecutive ones."""
        k = max(0, len(self.total) - n)
        return (self.total[n:] - self.total[:k]) * self.down[:k]


def byte_sums(data: np.ndarray, lower: bool = False) -> Sums:
    return Sums((_LOWER if lower else _CODES)[data], _BYTE_POWERS)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a chunk: start, end, hash and document of each."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False, space: np.ndarray = _SPACE):
        word = ~space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.concatenate([[False], word[:-1]]) if len(data) else word
        after = np.concatenate([word[1:], [False]]) if len(data) else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.is_word = word
        self.doc = np.searchsorted(at, self.start, "right") - 1
        self.sums = byte_sums(data, lower)
        self.hash = mix(self.sums.stretch(self.start, self.end) + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.doc, np.arange(len(at)))  # word number where each document begins

    def sequence(self) -> Sums:
        return Sums(self.hash, _WORD_POWERS)

    def inside(self, n: int) -> np.ndarray:
        """Whether the ``n`` words from each start are of one document."""
        k = max(0, len(self.doc) - n + 1)
        return self.doc[:k] == self.doc[n - 1 :][:k]


def least_in_windows(values: np.ndarray, w: int) -> np.ndarray:
    """Where, in each window of ``w`` values, the least is (leftmost on ties of its top 40 bits)."""
    n = len(values)
    if n < w:
        return np.empty(0, np.int64)
    low = np.uint64((1 << 24) - 1)
    if n > int(low):
        half = n // 2  # positions have 24 bits
        return np.concatenate([least_in_windows(values[: half + w - 1], w), least_in_windows(values[half:], w) + half])
    key = (values & ~low) | np.arange(n, dtype=np.uint64)
    m = -(-n // w) * w
    block = np.full(m, ~np.uint64(0))
    block[:n] = key
    block = block.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[: n - w + 1], ahead[w - 1 : n]) & low).astype(np.int64)
