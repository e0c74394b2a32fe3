"""Packing of tokenized documents into sequences of fixed length, by cutting-stock column generation.

A document's ids, ended by one extra id, are cut at multiples of the capacity. The pieces' lengths make a
histogram, which is all that reaches the driver: a bar for each length up to ``EXACT``, then for 8, 16 and at last
32 lengths, so that rounding up to a bar's greatest length loses little (some 230 bars at 4096). A linear program over
patterns (multisets of bars that fit a sequence) is solved for the longer pieces by the simplex method; an unbounded-knapsack
dynamic program prices new patterns. Pieces of up to a 64th of a sequence need no program: equal ones fill sequences up to a rest
below their length. Pattern counts are rounded down and what is left is packed first-fit decreasing, short pieces in the gaps and, at
last, in sequences whose length is a power of two where that comes out even. Pieces are ranked within their bar; the
rank names a sequence and a slot.

Ranks come from salted groups with known counts, so a bar that holds most pieces is dealt
over many tasks. A sequence that is not full is padded to the capacity unless its length is a power of two.

Defined results: a null or empty text is its end id alone; repeated rows are packed each by itself; a
null id is carried through; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import frugal, stash
from millrace.llm.token_ids import text_ids

#: Lengths up to this have bars of their own; then bars get wider: (lengths up to, lengths of a bar).
EXACT = 64
WIDTHS = ((256, 8), (1024, 16), (None, 32))
#: The linear program ends when it is proven to be within this share of the best.
GAP = 0.003
#: Pieces of one bar that are ranked in one group, and salts at most.
RANKED, MAX_SALTS = 50_000, 1024


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, start, length, ids_crc32, doc_tokens): one row for each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows, starts, lengths, crcs, totals = [], [], [], [], []
            for row, ids in text_ids(batch.column("text"), tokenizer):
                ids = np.concatenate([ids, end])
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    rows.append(row)
                    starts.append(at)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
            numbers = [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), *numbers], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(cut), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


class _Knapsack:
    """The multisets of items of most worth that fit into each room up to ``room``."""

    def __init__(self, worth: np.ndarray, sizes: np.ndarray, room: int):
        self.sizes, self.room = sizes, room
        self.best, self.taken, self.full = np.zeros(room + 1), np.full(room + 1, -1), np.zeros(room + 1, np.int64)
        for r in range(1, room + 1):
            n = int(np.searchsorted(sizes, r, "right"))
            self.best[r], self.full[r] = self.best[r - 1], self.full[r - 1]
            if n:
                gain = worth[:n] + self.best[r - sizes[:n]]
                k = int(np.argmax(gain))
                if gain[k] > self.best[r] + 1e-12:
                    self.best[r], self.taken[r], self.full[r] = gain[k], k, r

    def with_item(self, k: int) -> np.ndarray:
        """How often the best multiset that holds item k takes each item."""
        out, r = np.zeros(len(self.sizes), np.int64), self.full[self.room - self.sizes[k]]
        out[k] = 1
        while r > 0:  # ``full`` is the room that the best multiset really takes
            out[self.taken[r]] += 1
            r = self.full[r - self.sizes[self.taken[r]]]
        return out


def cutting_patterns(histogram: dict[int, int], room: int, gap: float = GAP, rounds: int = 300) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): patterns of sizes that fit into ``room``, used so often that every size of the histogram is placed exactly as often as it occurs.

    Each round of pricing gives for every size the best pattern that holds it; all that improve the program enter in turn.
    """
    sizes = np.array(sorted(s for s, n in histogram.items() if n), np.int64)
    if not len(sizes):
        return []
    demand = np.array([histogram[int(s)] for s in sizes], np.float64)
    basis = np.diag(room // sizes).astype(np.float64)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        price = inverse.sum(0)
        knapsack = _Knapsack(np.maximum(price, 0), sizes, room)
        value = knapsack.best[room]
        if value <= 1 + 1e-9 or 1 - 1 / value < gap:
            break
        good = np.flatnonzero((price > 0) & (price + knapsack.best[room - sizes] > 1 + 1e-9))
        columns = np.array([knapsack.with_item(int(k)) for k in good], np.float64).T
        if not _enter(basis, inverse, columns, demand, 0.15 * (value - 1)):
            break
    times = np.linalg.solve(basis, demand)
    whole = np.floor(np.maximum(times, 0) + 1e-9).astype(np.int64)
    while ((left := demand.astype(np.int64) - (basis.astype(np.int64) @ whole)) < 0).any():  # rounding noise of the solver
        whole[np.argmax((basis[left < 0].sum(0) > 0) & (whole > 0))] -= 1
    used = [({int(s): int(n) for s, n in zip(sizes, basis[:, k], strict=True) if n > 0.5}, int(whole[k])) for k in range(len(sizes)) if whole[k]]
    return used + [(p, 1) for p in _first_fit(dict(zip(sizes.tolist(), left.tolist(), strict=True)), room)]


def _enter(basis: np.ndarray, inverse: np.ndarray, columns: np.ndarray, demand: np.ndarray, least: float) -> int:
    """Simplex steps on ``basis`` with the given columns until none improves by ``least``; how many there were."""
    times = inverse @ demand
    for n in range(2 * len(demand)):
        worth = inverse.sum(0) @ columns
        j = int(np.argmax(worth))
        if worth[j] <= 1 + max(1e-9, least):
            return n
        step = inverse @ columns[:, j]
        up = np.flatnonzero(step > 1e-9)
        leaves = up[np.argmin(np.maximum(times[up], 0) / step[up])]
        basis[:, leaves] = columns[:, j]
        row = inverse[leaves] / step[leaves]
        inverse -= np.outer(step, row)
        inverse[leaves] = row
        times = inverse @ demand
    return n + 1


def _first_fit(left: dict[int, int], room: int) -> list[dict[int, int]]:
    """First-fit decreasing, several equal sizes at a time. What rounding leaves is a few pieces of each pattern."""
    bins: list[list] = []
    for size in sorted(left, reverse=True):
        n = left[size]
        for b in bins:
            if n and b[0] >= size:
                k = min(n, b[0] // size)
                b[0] -= k * size
                b[1][size] = b[1].get(size, 0) + k
                n -= k
        while n:
            k = min(n, room // size)
            bins.append([room - k * size, {size: k}])
            n -= k
    return [b[1] for b in bins]


def bar_of(length: int, capacity: int) -> int:
    """The greatest length of the bar that ``length`` falls in."""
    if length <= EXACT:
        return length
    width = next(w for most, w in WIDTHS if most is None or length <= most)
    return min(-(-length // width) * width, capacity)


def _short_patterns(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Sequences of equal short pieces, and what is left of each length."""
    out, left = [], {}
    for size, n in counts.items():
        times, left[size] = divmod(n, capacity // size)
        if times:
            out.append(({size: capacity // size}, times))
    return out, left


def _even_parts(left: dict[int, int], capacity: int) -> list[dict[int, int]]:
    """Short pieces of fewer than ``capacity`` tokens in sequences whose lengths are powers of two, as long as that comes out even, and the rest in one."""
    left, out = dict(left), []
    power = 1 << max(capacity, 1).bit_length()
    while power > 1:
        power //= 2
        part, room = {}, power
        for size in sorted(left, reverse=True):
            k = min(left[size], room // size)
            if k:
                part[size] = k
                room -= k * size
        if part and not room:
            out.append(part)
            left = {s: n - part.get(s, 0) for s, n in left.items()}
    rest = {s: n for s, n in left.items() if n}
    return out + ([rest] if rest else [])


def packing_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times) for all bars: patterns of longer bars by column generation, short ones by themselves, the rest of both together."""
    short = min(EXACT, capacity // EXACT)  # a rest below a short length is little of a sequence
    long = {s: n for s, n in histogram.items() if s > short and n}
    unit = math.gcd(capacity, *long) if long else 1
    patterns = [({s * unit: n for s, n in p.items()}, times) for p, times in cutting_patterns({s // unit: n for s, n in long.items()}, capacity // unit)]
    full, left = _short_patterns({s: n for s, n in histogram.items() if s <= short and n}, capacity)
    # sequences of one kind only are few; short pieces fill up their gaps
    for k, (pattern, times) in enumerate(patterns):
        if times == 1:
            room, pattern = capacity - sum(s * n for s, n in pattern.items()), dict(pattern)
            for size in sorted(left, reverse=True):
                n = min(left[size], room // size)
                if n:
                    pattern[size] = n
                    left[size] -= n
                    room -= n * size
            patterns[k] = (pattern, 1)
    even = []
    for part in _first_fit({s: n for s, n in left.items() if n}, capacity):
        even += _even_parts(part, capacity)
    return patterns + full + [(p, 1) for p in even]


def _slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each bar: the first rank of each run of slots, the run's first sequence and its slot within the sequence."""
    runs: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        slot = 0
        for size, copies in sorted(pattern.items(), reverse=True):
            for _ in range(copies):
                runs.setdefault(size, []).append((seen.get(size, 0), sequence, slot))
                seen[size] = seen.get(size, 0) + times
                slot += 1
        sequence += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*r, strict=True)) for size, r in runs.items()}


def pack(pieces: DataFrame, capacity: int, length_col: str = "length", order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """The input with ``sequence_id``, ``offset`` (gapless from 0 within the sequence) and ``padded_length`` of the sequence."""
    spark = pieces.sparkSession
    n = F.col(length_col)
    bar = F.when(n <= EXACT, n)
    for most, width in WIDTHS:
        bar = bar.when(n <= (most or capacity), F.least(F.ceil(n / width) * width, F.lit(capacity)))
    bar = bar.cast("int")
    pieces = stash(pieces.withColumn("_bar", bar), "pieces")
    most = pieces.groupBy("_bar").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    salts = int(min(MAX_SALTS, 1 + most // RANKED))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy("_bar", "_salt").agg(F.count("*").alias("n")).collect()  # at most bars * MAX_SALTS rows
    histogram: dict[int, int] = {}
    base: dict[tuple[int, int], int] = {}
    for r in sorted(counts, key=lambda r: (r._bar, r._salt)):
        base[r._bar, r._salt] = histogram.get(r._bar, 0)
        histogram[r._bar] = histogram.get(r._bar, 0) + r.n
    plan = spark.sparkContext.broadcast((_slots(packing_patterns(histogram, capacity)), base))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_bar", "_salt").orderBy(*order)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, first = plan.value
        for batch in batches:
            bars, salt, rank = (batch.column(c).to_numpy() for c in ("_bar", "_salt", "_rank"))
            sequence, slot = np.zeros(len(bars), np.int64), np.zeros(len(bars), np.int64)
            for b in np.unique(bars):
                at = np.flatnonzero(bars == b)
                own = rank[at] - 1 + np.array([first[int(b), int(s)] for s in salt[at]], np.int64)
                ranks, sequences, places = slots[int(b)]
                run = np.searchsorted(ranks, own, "right") - 1
                sequence[at], slot[at] = sequences[run] + own - ranks[run], places[run]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(slot)], ["row", "sequence_id", "slot"])

    columns = [c for c in pieces.columns if c not in ("_bar", "sequence_id", "offset", "padded_length")]
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    kept = ranked.select(row.alias("row"), "_bar", "_salt", "_rank")
    placed = kept.mapInArrow(frugal(place), f"row {kept.schema['row'].dataType.simpleString()}, sequence_id long, slot long")
    within = Window.partitionBy("sequence_id")  # at most ``capacity`` pieces
    length = F.col(f"row.`{length_col}`")
    total = F.sum(length).over(within)
    offset = F.sum(length).over(within.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - length
    padded = F.when(total.bitwiseAND(total - 1) == 0, total).otherwise(F.lit(capacity))
    return placed.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "sequence_id", offset.cast("long").alias("offset"), padded.cast("long").alias("padded_length"))


def packed_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded_length."""
    # rows that tie in all of these are equal, so a task that runs again gives the same rows
    order = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    return pack(token_pieces(docs.select("doc_id", "text"), tokenizer, end_id, capacity), capacity, order=order)
