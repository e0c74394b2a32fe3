"""Runs: stretches of a text's words that repeat with a short period, found by bit-parallel lags.

The words of a block of texts get dense ids; texts are parted by ids that occur once. Bit b of all ids
makes a plane, one big integer. For a lag q each plane is XORed with itself shifted by q, the results
are ORed: a zero says that a word equals the one q places on. Shift-doubling ANDs keep the places where
enough zeros follow each other. Lags go upward, so a stretch that lies in a run found before has a smaller
period and is left out.

Small lags are tested over the whole block. Of the lags from B to 2B (B a power of two) only those are
tested, and only in those parts, where some aligned B words come again q places on: a run of at least
three periods holds such a pair, and a hash that doubles from level to level finds all of them in one
comparison a word. Pairs inside a run of a period of at most B words are left out: by the theorem of Fine and
Wilf none of these supports a run of a longer smallest period. So a text of one word over and over costs no more than others.

Defined results: a null text has no runs and stays null; an empty one has none; repeated rows are judged each by
itself; an empty table gives an empty result; further columns are carried, those named ``runs`` or
``collapsed`` are replaced. Equal 64-bit hashes are taken for equal words. A text's temporary arrays
take about a hundred times its bytes, and a block holds 1 MB of texts or one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import frugal
from millrace.llm.textblocks import TextBlock, blocks, mix

#: Lags below this are tested over the whole block.
DIRECT = 16
WORDS = r"[^\x20\x09-\x0D]+"
_RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def bit_planes(ids: np.ndarray) -> np.ndarray:
    """Packed bits of ``ids``, least significant bit and first id first, one row for each bit."""
    bits = int(ids.max()).bit_length() if len(ids) else 0
    return np.array([np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little") for b in range(bits)])


def _ones(x: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def lag_stretches(planes: list[int], n: int, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of period ``lag`` among ``n`` words in which ``least`` words or more equal those ``lag`` places on."""
    differs = 0
    for plane in planes:
        differs |= plane ^ (plane >> lag)
    if n - lag < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    every = (1 << (n - lag)) - 1
    equal = every ^ (differs & every)
    long, width = equal, 1
    while width < least and long:
        step = min(width, least - width)
        long &= long >> step
        width += step
    if not long:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts, lasts = _ones(long & ~(long << 1), n), _ones(long & ~(long >> 1), n)
    return starts, lasts + least + lag


class _Found:
    """Runs found so far, and for each place the furthest end of those that start at it or before."""

    def __init__(self, n: int):
        self.n, self.parts, self.reach = n, [], np.zeros(n + 1, np.int64)

    def add(self, starts: np.ndarray, ends: np.ndarray, period: int) -> None:
        """Those of the stretches that lie in no run of a smaller period."""
        own = self.reach[starts] < ends
        starts, ends = starts[own], ends[own]
        if len(starts):
            self.parts.append((starts, ends - starts, np.full(len(starts), period)))
            reach = self.reach.copy()
            np.maximum.at(reach, starts, ends)
            self.reach = np.maximum.accumulate(reach)

    def runs(self) -> np.ndarray:
        """(start, length, period), by start and period."""
        if not self.parts:
            return np.zeros((0, 3), np.int64)
        out = np.concatenate([np.column_stack(p) for p in self.parts])
        return out[np.lexsort((out[:, 2], out[:, 0]))]


def _parts(places: np.ndarray, size: int, lag: int, n: int) -> Iterator[tuple[int, int]]:
    """Parts of the block that hold all runs supported by the aligned blocks at ``places``, and the words next to these runs."""
    cuts = np.flatnonzero(np.diff(places) > 4) + 1
    for group in np.split(places, cuts):
        yield max(0, int(group[0] - 1) * size) // 8 * 8, min(n, (int(group[-1] + 2) * size + lag + 7) // 8 * 8)


def runs_of(ids: np.ndarray, longest: int, min_length: int = 6, min_exponent: int = 4) -> np.ndarray:
    """(start, length, period) of all runs in ``ids``, by start and period.

    ``ids`` begins and ends with ids that occur once; ``longest`` is the number of words of the longest text.
    """
    if min_exponent < 3:
        raise ValueError("runs of less than three periods can escape the aligned blocks")
    n, found, packed = len(ids), _Found(len(ids)), bit_planes(ids)
    most = longest // min_exponent
    least = lambda q: max(1, min_length - q, (min_exponent - 1) * q)
    whole = [int.from_bytes(p.tobytes(), "little") for p in packed]
    for lag in range(1, min(DIRECT, most + 1)):
        found.add(*lag_stretches(whole, n, lag, least(lag)), lag)
    hashes, size = mix(ids.astype(np.uint64)), 1
    while 2 * size <= most:
        hashes = mix(hashes[:-size] * np.uint64(0xD6E8FEB86659FD93) + hashes[size:])
        size *= 2
        if size < DIRECT:
            continue
        rows = np.append(hashes, np.zeros(-len(hashes) % size, np.uint64)).reshape(-1, size)
        place, column = np.nonzero(rows[1:] == rows[:-1, :1])
        lag = column + size
        own = (lag <= most) & (found.reach[place * size] < place * size + lag + size)
        place, lag = place[own], lag[own]
        order = np.lexsort((place, lag))
        place, lag = place[order], lag[order]
        for group in np.split(np.arange(len(lag)), np.flatnonzero(np.diff(lag)) + 1):
            if len(group):
                q = int(lag[group[0]])
                starts, ends = _lag_in_parts(packed, place[group], size, q, n, least(q))
                found.add(starts, ends, q)
    return found.runs()


def _lag_in_parts(packed: np.ndarray, places: np.ndarray, size: int, lag: int, n: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """``lag_stretches`` in the parts around ``places``; a stretch that a part cuts off belongs to another part, or is none."""
    found: set[tuple[int, int]] = set()
    for low, high in _parts(places, size, lag, n):
        planes = [int.from_bytes(p[low // 8 : (high + 7) // 8].tobytes(), "little") for p in packed]
        starts, ends = lag_stretches(planes, high - low, lag, least)
        inside = ((starts > 0) | (low == 0)) & ((ends < high - low) | (high == n))
        found.update(zip((starts[inside] + low).tolist(), (ends[inside] + low).tolist(), strict=True))
    out = np.array(sorted(found), np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def block_runs(block: TextBlock, min_length: int = 6, min_exponent: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the block that have runs, once a run, and the runs with starts counted from their text's first word."""
    words, dense = np.unique(block.word_hashes(), return_inverse=True)
    ids = np.empty(len(dense) + block.rows + 1, np.int64)
    first = block.word_offsets[:-1] + np.arange(block.rows) + 1  # a parting id stands before each text and after the last
    parting = np.append(first - 1, len(ids) - 1)
    ids[parting] = len(words) + np.arange(block.rows + 1)
    ids[np.arange(len(dense)) + block.word_row + 1] = dense
    runs = runs_of(ids, int(block.n_words.max(initial=0)), min_length, min_exponent)
    rows = np.searchsorted(first, runs[:, 0], "right") - 1
    # empty texts share no place with a word, so the last text that starts at or before a run is its own
    runs[:, 0] -= first[rows]
    return rows, runs


def _collapsed(text: bytes, runs: np.ndarray) -> bytes:
    """The words, without those that a run holds after its first period, joined by one space."""
    words = text.split()
    if not len(runs):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def find_runs(docs: DataFrame, text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """The input with ``runs``, an array of (start, length, period) in words by start and period, and ``collapsed``, the text's words without repeats of a run's first period.

    A run is a stretch of at least ``min_length`` words and ``min_exponent`` times its smallest period that can't be extended.
    """
    carried = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col)
            for block in blocks(texts):
                rows, runs = block_runs(block, min_length, min_exponent)
                by_row = np.searchsorted(rows, np.arange(block.rows + 1))
                found = pa.ListArray.from_arrays(pa.array(by_row, pa.int32()), pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in range(3)], fields=list(_ARROW_RUN)))
                known = texts.slice(block.first, block.rows).is_valid().to_pylist()
                kept = [_collapsed(block.text(k), runs[by_row[k] : by_row[k + 1]]) if known[k] else None for k in range(block.rows)]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).slice(block.first, block.rows) for f in carried], found, pa.array(kept, pa.binary()).cast(pa.string())], [*[f.name for f in carried], "runs", "collapsed"])

    schema = T.StructType([*carried, T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in carried]).mapInArrow(frugal(mark), schema)


def planted(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The texts to judge: those whose id's checksum ends in 0 go on, from some word, with one stretch of theirs again and again; a null id plants nothing."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORDS), F.lit(0))
    n, h = F.size(words).cast("long"), F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    a = g % F.greatest(n, F.lit(1))
    rest = n - a
    period = 1 + F.floor(rest / (3 + g % 8))
    stretch = F.slice(words, (a + 1).cast("int"), period.cast("int"))
    times = (F.floor(rest / period) + 1).cast("int")
    told = F.slice(F.flatten(F.array_repeat(stretch, times)), F.lit(1), rest.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), told), " ")).otherwise(F.col(text_col))


def run_digests(docs: DataFrame) -> DataFrame:
    """Per document, of its planted text: the number of runs, the longest (ties: smallest start, then period) with its exponent, and digests of all runs and of the words that stay."""
    found = find_runs(docs.select("doc_id", planted().alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"])))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    spelled = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(spelled, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.less"), F.col("best.period")
    return told.select("doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
