"""Words, lines and their hashes for blocks of texts, vectorised over the bytes of Arrow string columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. A span of bytes (a word, a line) gets a 64-bit
hash: eight bytes after eight are mixed in by multiplications and shifts, which is not linear in
the bytes, so spans of one pattern over two letters don't fall together; a long span is hashed by xxhash.
The hash depends on the bytes only, so equal spans have equal hashes in every task. Shingles combine the hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text whose temporary arrays are held at a time (about 40 times as much memory).
BLOCK_BYTES = 1_000_000
#: Spans of more bytes than this are hashed one by one.
LONG_SPAN = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks that keep the first 0 to 8 bytes of a little-endian word.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number, and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, _INVERSE):
        row = np.full(n, base, np.uint64)
        row[:1] = 1
        out.append(np.multiply.accumulate(row))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end) of ``data``."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    n = ends - starts
    out = mix(n.astype(np.uint64) + _BASE)
    left = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at, rest, h = starts[left], n[left], out[left]
    while len(left):
        h = mix((h ^ (eight[at] & _FIRST[np.minimum(rest, 8)])) * _BASE)
        more = rest > 8
        out[left] = h
        left, at, rest, h = left[more], at[more] + 8, rest[more] - 8, h[more]
    for k in np.flatnonzero(n > LONG_SPAN):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


class TextBlock:
    """Some texts of a column, with the places of their words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.rows = len(offsets) - 1
        inside = ~_SPACE[data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        if len(data):
            before[1:], after[:-1] = inside[:-1], inside[1:]
            before[offsets[:-1][offsets[:-1] < len(data)]] = False
            after[offsets[1:][offsets[1:] > 0] - 1] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.word_offsets = np.searchsorted(self.starts, offsets)
        self.n_words = np.diff(self.word_offsets)
        self.word_row = np.repeat(np.arange(self.rows), self.n_words)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hashes of the byte spans [start, end); with ``lower``, of A-Z lower-cased."""
        return span_hashes(_LOWER[self.data] if lower else self.data, starts, ends)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends, lower)

    def row_sums(self, flags: np.ndarray) -> np.ndarray:
        """For each row, the sum of a per-byte array."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the lines, split at \\n; an empty text is one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        row = np.searchsorted(self.offsets, breaks, "right") - 1
        starts = np.concatenate([self.offsets[:-1], breaks + 1])
        ends = np.concatenate([self.offsets[1:], breaks])
        rows = np.concatenate([np.arange(self.rows), row])
        by_start = np.lexsort((np.concatenate([np.zeros(self.rows, np.int8), np.ones(len(breaks), np.int8)]), starts, rows))
        by_end = np.lexsort((np.concatenate([np.ones(self.rows, np.int8), np.zeros(len(breaks), np.int8)]), ends, rows))
        return starts[by_start], ends[by_end], rows[by_start]


def windows(hashes: np.ndarray, word_row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words within one row, and the index of each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n]
    first = np.flatnonzero(word_row[:n] == word_row[size - 1 :])
    return mix(total[first]), first


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[TextBlock]:
    """The texts of a string column in blocks of about ``limit`` bytes (a longer text is a block of its own); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.fill_null(b"" if pa.types.is_binary(column.type) else "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        end = min(end, len(column))
        yield TextBlock(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end
