"""Vectorised words and word hashes over Arrow string columns.

A *word* is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased
text; everything else separates.  A word's 64-bit hash is a polynomial over randomised bytes, taken
from one running sum over the buffer, so a batch costs a few numpy passes and no Python loop per
word.  Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)

WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
WORD_BYTE[128:] = True

#: The same definition for SQL engines.
WORD_PATTERN = r"[0-9a-z\x{80}-\x{10FFFF}]+"

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, U64(base & _MASK))
            steps[0] = U64(1)
            tables.append(np.cumprod(steps, dtype=U64))
        _powers = (tables[0], tables[1])
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (length rows + 1) of a string column; a null row is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if len(texts) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that stay inside one row."""
    n = len(member)
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = member[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = member[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE_CODE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


class Words:
    """The words of a batch: hashes, byte spans, and each row's range ``row[i]:row[i + 1]``."""

    __slots__ = ("data", "ends", "hashes", "offsets", "row", "starts")

    def __init__(self, texts: pa.Array, lower: bool = True):
        self.data, self.offsets = string_buffers(pc.utf8_lower(texts) if lower else texts)
        self.starts, self.ends = runs(WORD_BYTE[self.data], self.offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self.row = np.searchsorted(self.starts, self.offsets)


def slices(texts: pa.Array, most_bytes: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most_bytes`` of text each; every row is in one, whole."""
    _, offsets = string_buffers(texts)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        yield row, min(stop, len(texts))
        row = stop


_GRAM = [U64((0xD6E8FEB86659FD93 * (2 * i + 1) ^ (i * 0xA0761D6478BD642F)) & _MASK | 1) for i in range(64)]


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of each row, and the word position of each.

    A row of fewer than ``n`` words, but one at least, has a single gram of all its words.
    """
    total, lengths = len(hashes), np.diff(row)
    if total == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    padded = np.concatenate([hashes, np.zeros(n - 1, U64)])
    out = np.zeros(total, U64)
    for i in range(n):
        out += padded[i : i + total] * _GRAM[i]
    valid = np.ones(total, bool)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    for back in range(1, n):
        tail = row[1:] - back
        valid[tail[lengths >= back]] = False
    for r in short:
        a, b = row[r], row[r + 1]
        acc = 0
        for i in range(b - a):
            acc = (acc + int(hashes[a + i]) * int(_GRAM[i])) & _MASK
        out[a] = U64(acc)
        valid[a] = True
    at = np.flatnonzero(valid)
    return mix(out[at]), at
