"""Vectorised work on the UTF-8 bytes of Arrow text columns: slices, words, hashes. Everything here is pure numpy."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # a working slice holds whole texts up to this size, or one longer text
CHUNK_BYTES = 1 << 20  # hashes of words are taken over this many bytes at a time

_rng = np.random.default_rng(20240501)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown as needed; travels to tasks empty."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __reduce__(self):
        return _Powers, ()

    def tables(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            def table(base):
                steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
                steps[0] = 1
                return np.multiply.accumulate(steps)
            self.up, self.down = table(BASE), table(INVERSE)
        return self.up, self.down


POWERS = _Powers()


@dataclass
class Slice:
    """Rows lo..hi of a batch: their bytes end to end, and where each text begins (one offset more than rows)."""
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        """The row (counted from lo) that holds each byte position."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole texts in runs of at most `most` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "") if column.null_count or not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield Slice(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Marks the bytes within the given inclusive ranges."""
    table = np.zeros(256, bool)
    for first, last in ranges:
        table[first:last + 1] = True
    return table


NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))  # words [^\x20\x09-\x0D]+
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))  # words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once lower-cased
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def words(piece: Slice, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every maximal run of marked bytes that stays within one text."""
    inside = table[piece.data]
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = piece.offsets[(piece.offsets > 0) & (piece.offsets < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial hash; entry i covers the first i bytes. See span_hash."""
    powers, _ = POWERS.tables(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes begin..end, the same wherever they stand."""
    _, inverses = POWERS.tables(len(prefix))
    return mix((prefix[end] - prefix[begin]) * inverses[begin])


def word_hashes(piece: Slice, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word, taken chunk by chunk so that memory does not follow the length of a text."""
    out = np.empty(len(begin), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + CHUNK_BYTES, side="right")))
        part = piece.data[begin[i]:end[j - 1]]
        prefix = prefix_hash(LOWER[part] if lower else part)
        out[i:j] = span_hash(prefix, begin[i:j] - begin[i], end[i:j] - begin[i])
        i = j
    return out


def word_counts(piece: Slice, begin: np.ndarray) -> np.ndarray:
    """First word index of each text, and one entry more."""
    return np.searchsorted(begin, piece.offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def byte_grams(piece: Slice, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Every run of n (at most 8) bytes within one text, packed into an integer, and the position where it begins."""
    data = LOWER[piece.data] if lower else piece.data
    m = len(data) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    packed = np.zeros(m, np.uint64)
    for j in range(n):
        packed = (packed << np.uint64(8)) | data[j:j + m]
    inside = np.ones(m, bool)
    for j in range(1, n):
        cut = piece.offsets[1:-1] - j
        inside[cut[(cut >= 0) & (cut < m)]] = False
    at = np.flatnonzero(inside)
    return packed[at], at


def bucketed(packed: np.ndarray, bits: int, seed: int = 1) -> np.ndarray:
    """Multiply-shift hash of packed grams to `bits` bits."""
    return ((packed * np.uint64(0x9E3779B97F4A7C15 + 2 * seed)) >> np.uint64(64 - bits)).astype(np.int64)
