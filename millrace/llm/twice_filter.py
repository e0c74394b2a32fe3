"""Two Bloom filters over 64-bit hashes: bits of values seen once, and bits seen at least twice.

A task fills a pair of bit arrays from its own values; pairs are merged by
``twice = twice1 | twice2 | (once1 & once2)``. A value added twice has all its bits in
``twice``, so a miss there proves that it was added once at most.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import frugal

PROBES = 4
#: Each of the two filters takes this much memory at most (128 MB); beyond about 130 million values more and more single ones count as suspects, which costs work, not correctness.
MAX_BITS = 1 << 30
#: Bits of a filter that travel and are merged as one row.
CHUNK_BITS = 1 << 22


def filter_bits(n_values: int, max_bits: int = MAX_BITS) -> int:
    """16 bits a value, as a power of two within the bounds."""
    return int(min(max_bits, max(1 << 16, 1 << (16 * max(1, n_values) - 1).bit_length())))


def _places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((hashes + np.uint64(k) * step) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)


class TwicePair:
    def __init__(self, bits: int):
        self.bits = bits
        self.once, self.twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """Each value of ``hashes`` counts as one sight of it."""
        for place in _places(hashes, self.bits):
            # several values of this call may share a bit: what is not new within the call is a second sight
            place, count = np.unique(place, return_counts=True)
            byte, bit = place >> 3, np.uint8(1) << (place & 7).astype(np.uint8)
            seen = (self.once[byte] & bit) != 0
            np.bitwise_or.at(self.twice, byte[seen | (count > 1)], bit[seen | (count > 1)])
            np.bitwise_or.at(self.once, byte, bit)

    def chunks(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = min(CHUNK_BITS, self.bits) // 8
        for k in range(self.bits // 8 // size):
            once = self.once[k * size : (k + 1) * size]
            if once.any():
                yield k, _packed(once), _packed(self.twice[k * size : (k + 1) * size])


def _packed(chunk: np.ndarray) -> bytes:
    """The bytes of a chunk that are not 0, after their distances: a part of a filter is sparse, and so takes about 1.3 bytes for each of them."""
    at = np.flatnonzero(chunk)
    steps = np.diff(at, prepend=-1).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(np.concatenate([steps.T.ravel(), chunk[at]]), 1)


def _unpacked(packed: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(5, -1)
    out = np.zeros(size, np.uint8)
    out[np.cumsum(planes[:4].T.copy().view("<u4").ravel(), dtype=np.int64) - 1] = planes[4]
    return out


def suspected(twice: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each value may have been added twice; ``twice`` is the merged filter."""
    bits, out = len(twice) * 8, np.ones(len(hashes), bool)
    for place in _places(hashes, bits):
        out &= (twice[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return out


def build_twice_filter(rows: DataFrame, hashes_of, bits: int) -> np.ndarray:
    """The merged ``twice`` filter (``bits / 8`` bytes) of all values that ``hashes_of(batch)`` yields for the Arrow batches of ``rows``.

    Tasks send compressed chunks; chunks of one place are merged on the executors, so the driver gets one filter of a fixed size.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = TwicePair(bits)
        for batch in batches:
            for hashes in hashes_of(batch):
                pair.add(hashes)
        for k, once, twice in pair.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([once], pa.binary()), pa.array([twice], pa.binary())], ["chunk", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, *pair in zip(*[batch.column(c).to_pylist() for c in ("chunk", "once", "twice")], strict=True):
                once, twice = (_unpacked(x, size) for x in pair)
                if k in held:
                    held[k][1] |= twice | (held[k][0] & once)
                    held[k][0] |= once
                else:
                    held[k] = [once, twice]
        for k, (once, twice) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([_packed(once)], pa.binary()), pa.array([_packed(twice)], pa.binary())], ["chunk", "once", "twice"])

    size, schema = min(CHUNK_BITS, bits) // 8, "chunk long, once binary, twice binary"
    parts = rows.mapInArrow(frugal(fill), schema)
    # a first merge in random groups, then one task for each chunk: no task gets every part of a chunk unmerged
    salted = parts.repartition(F.col("chunk"), F.pmod(F.xxhash64("once"), F.lit(8))).mapInArrow(frugal(merge), schema)
    merged = salted.repartition("chunk").mapInArrow(frugal(merge), schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("chunk", "twice").toLocalIterator():
        out[row.chunk * size : (row.chunk + 1) * size] = _unpacked(bytes(row.twice), size)
    return out
