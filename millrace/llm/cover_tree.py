"""Exact pairs of near vectors by dual traversal of cover trees.

1. Vectors are scaled to unit length in double precision, by their largest component first; equal vectors become one with a weight.
2. Pivots, chosen by farthest-first from a bounded sample, split the vectors into cells; a cell of
   more than ``CELL_ROWS`` vectors is dealt into several by hash.
3. Every cell gets a cover tree: nested levels of centres with halving radii. A cell is written as one row, in the
   precision of the input.
4. Pairs of cells meet in a Cartesian product of these rows, which is read from the written table and not shuffled, so disk
   grows with the number of vectors while the work grows with that of pairs. Cells whose pivots are too far apart
   don't meet. For a vector in the cell of pivot p and a partner within distance t in the cell of pivot q,
   ``x.(p - q) <= t * |p - q|`` holds, and ``|x - q| <= t + radius of q``: others are left out first.
   Then both trees are descended together, from the lowest level that has few more nodes than the root's children: where a
   coarse level hardly joins vectors, its wide radii exclude nothing. Pairs of nodes that are farther apart than
   their covering radii and t allow are dropped; pairs whose farthest members are within t link as a whole;
   the rest go down to pairs of vectors, whose cosine is computed.
5. Counts are summed per vector; links, reduced to a spanning forest within each task, give components.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or whose
id is null, has no links and is a component of its own; vectors of different length don't link; rows that share an id count as vectors of
their own and share their component; an empty table gives an empty result.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.links import connected_components
from millrace.llm.shared import discard, stash

#: Vectors of a cell; a task holds two cells.
CELL_ROWS = 2048
#: Rows from which pivots are chosen, and pivots, at most.
SAMPLE_ROWS, MAX_PIVOTS = 4096, 256
#: Radii of the nested levels below the root, on the unit sphere.
RADII = (1.0, 0.5, 0.25, 0.125)
_EPS = 1e-7
#: The descent starts at the lowest level whose nodes make at most so many times the pairs of the uppermost one's.
_START = 2
#: Node pairs whose distances are computed at a time.
_CHUNK = 1 << 17
#: Entries of a matrix of node pairs, which shall stay in a core's cache.
_BLOCK = 1 << 19
#: Pairs of cells that a task takes from Spark at a time.
_PAIRS = 8


def _matrix(column: pa.Array) -> np.ndarray:
    """Fixed-length lists as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    chosen = [0]
    nearest = 2 - 2 * sample @ sample[0]
    while len(chosen) < min(k, len(sample)):
        far = int(np.argmax(nearest))
        if nearest[far] <= _EPS:
            break
        chosen.append(far)
        nearest = np.minimum(nearest, 2 - 2 * sample @ sample[far])
    return sample[chosen]


def cover_paths(x: np.ndarray) -> np.ndarray:
    """For each vector its centre at every level of ``RADII``: an index into ``x``. Centres are nested: a node's own centre is a centre of all lower levels."""
    n = len(x)
    paths, parent = np.zeros((n, len(RADII)), np.int32), np.zeros(n, np.int32)
    dots = x @ x.T if n <= 2 * CELL_ROWS else None
    for level, radius in enumerate(RADII):
        least = 1 - radius * radius / 2
        order = np.argsort(parent, kind="stable")
        starts = np.flatnonzero(np.diff(parent[order], prepend=-1))
        ends = np.append(starts[1:], n)
        if level:  # a centre alone stays its own
            paths[:, level] = parent
            starts, ends = starts[ends - starts > 1], ends[ends - starts > 1]
        for s, e in zip(starts, ends, strict=True):
            left = order[s:e]
            centre = parent[left[0]] if level else left[0]
            while len(left):
                near = (x[left] @ x[centre] if dots is None else dots[centre][left]) >= least
                near |= left == centre
                paths[left[near], level] = centre
                left = left[~near]
                if len(left):
                    centre = left[0]
        parent = paths[:, level]
    return paths


class Nodes:
    """The nodes of one cell's tree at one level."""

    def __init__(self, x: np.ndarray, w: np.ndarray, centre_of: np.ndarray):
        self.centres, self.of = np.unique(centre_of, return_inverse=True)
        gap = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", x, x[centre_of])))
        self.radius = np.zeros(len(self.centres))
        np.maximum.at(self.radius, self.of, gap)
        self.radius[self.radius > 0] += _EPS
        self.weight = np.bincount(self.of, w, len(self.centres))
        self.at = x[self.centres]
        order = np.argsort(self.of, kind="stable")
        self.members, self.starts = order, np.searchsorted(self.of[order], np.arange(len(self.centres) + 1))


def _children(level: Nodes, below: Nodes) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of ``below`` in the order of their parents, and where each parent's begin."""
    parent = level.of[below.centres]
    order = np.argsort(parent, kind="stable")
    return order, np.searchsorted(parent[order], np.arange(len(level.centres) + 1))


def _spread(a, b, ca, cb) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of children of the node pairs (a, b), in chunks."""
    (oa, sa), (ob, sb) = ca, cb
    na, nb = sa[a + 1] - sa[a], sb[b + 1] - sb[b]
    total = np.cumsum(na * nb)
    at = 0
    while at < len(a):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _CHUNK, "right")))
        n = (na * nb)[at:end]
        row = np.repeat(np.arange(at, end), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        yield oa[sa[a[row]] + k // nb[row]], ob[sb[b[row]] + k % nb[row]]
        at = end


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, least of its component) for the ids in the links (a, b)."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = places[: len(a)], places[len(a) :]
    low = np.arange(len(ids))
    while True:
        before = low.copy()
        m = np.minimum(low[i], low[j])
        np.minimum.at(low, low[i], m)
        np.minimum.at(low, low[j], m)
        low = low[low]
        if (low == before).all():
            break
    keep = low != np.arange(len(ids))
    return ids[keep], ids[low[keep]]


def dual_traversal(xa, wa, pa_, xb, wb, pb, cosine: float):
    """Weighted links of each vector of a and of b to the other side's, and links (i, j) that span the components. With ``xb is xa``, b's counts equal a's and each vector links with itself too."""
    reach = np.sqrt(2 - 2 * cosine)
    count_a, count_b, links = np.zeros(len(xa)), np.zeros(len(xb)), []
    a = b = ia = ib = None
    start = _first_level(pa_, pb)
    for level in range(start, len(RADII) + 1):
        last = level == len(RADII)
        na = Nodes(xa, wa, np.arange(len(xa)) if last else pa_[:, level])
        nb = Nodes(xb, wb, np.arange(len(xb)) if last else pb[:, level])
        next_a, next_b = [], []
        for ca, cb in _spread(ia, ib, _children(a, na), _children(b, nb)) if level > start else ():
            dot = np.einsum("ij,ij->i", na.at[ca], nb.at[cb])
            gap = np.sqrt(np.maximum(0, 2 - 2 * dot))
            _decide(na, nb, ca, cb, dot, gap, reach, cosine, last, count_a, count_b, links, next_a, next_b, xa, xb)
        if level == start:  # the first nodes meet as matrices
            for ca, cb in _first_pairs(na, nb, reach):
                dot = np.einsum("ij,ij->i", na.at[ca], nb.at[cb])
                gap = np.sqrt(np.maximum(0, 2 - 2 * dot))
                _decide(na, nb, ca, cb, dot, gap, reach, cosine, last, count_a, count_b, links, next_a, next_b, xa, xb)
        a, b = na, nb
        ia, ib = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (next_a, next_b))
        if not len(ia):
            break
    if links:
        return count_a, count_b, np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
    return count_a, count_b, np.zeros(0, np.int64), np.zeros(0, np.int64)


def _first_level(pa_: np.ndarray, pb: np.ndarray) -> int:
    """The level from which two trees are descended: a lower one has smaller radii, and costs more only by its nodes."""
    pairs = [len(np.unique(pa_[:, level])) * len(np.unique(pb[:, level])) for level in range(len(RADII))]
    return max(level for level in range(len(RADII)) if pairs[level] <= _START * pairs[0])


def _first_pairs(na: Nodes, nb: Nodes, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes that may hold near vectors, and few others. Nodes of one vector need no bound of their own, so they meet in single precision with a margin for its errors."""
    margin = 1e-7 * (na.at.shape[1] + 4)
    alone_a, alone_b = np.flatnonzero(na.radius == 0), np.flatnonzero(nb.radius == 0)
    wide_a, wide_b = np.flatnonzero(na.radius > 0), np.flatnonzero(nb.radius > 0)
    single = na.at[alone_a].astype(np.float32), nb.at[alone_b].astype(np.float32)
    least = np.float32(1 - (reach + _EPS) ** 2 / 2 - margin)
    for own, other, x, y in ((alone_a, alone_b, *single), (wide_a, np.arange(len(nb.at)), None, None), (alone_a, wide_b, None, None)):
        if not len(own) or not len(other):
            continue
        step = max(1, _BLOCK // len(other))
        for s in range(0, len(own), step):
            some = own[s : s + step]
            if x is not None:
                near = x[s : s + step] @ y.T >= least
            else:
                bound = reach + na.radius[some, None] + nb.radius[None, other] + 2 * _EPS
                near = 2 - 2 * (na.at[some] @ nb.at[other].T) <= bound * bound
            ca, cb = np.divmod(np.flatnonzero(near), len(other))
            for k in range(0, len(ca), _CHUNK):
                yield some[ca[k : k + _CHUNK]], other[cb[k : k + _CHUNK]]


def _decide(na, nb, ca, cb, dot, gap, reach, cosine, last, count_a, count_b, links, next_a, next_b, xa, xb):
    """Prune node pairs, link whole ones, pass the others on; at the last level the nodes are vectors."""
    if last:
        hit = dot >= cosine
        for k in np.flatnonzero(np.abs(dot - cosine) < 1e-9):
            x, y = xa[na.centres[ca[k]]], xb[nb.centres[cb[k]]]
            hit[k] = x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine
        whole, open_ = hit, np.zeros(len(hit), bool)
    else:
        radii = na.radius[ca] + nb.radius[cb]
        whole = gap + radii <= reach - _EPS
        open_ = ~whole & (gap <= reach + radii + _EPS)
    if whole.any():
        wa, wb = ca[whole], cb[whole]
        count_a += np.bincount(wa, nb.weight[wb], len(na.centres))[na.of]
        count_b += np.bincount(wb, na.weight[wa], len(nb.centres))[nb.of]
        links.append((na.centres[wa], nb.centres[wb]))
        # all members of a node that is linked as a whole are linked, through any one of the other side, with its centre
        for side, node, swap in ((na, np.unique(wa), False), (nb, np.unique(wb), True)):
            inside = np.isin(side.of, node)
            first = np.full(len(side.centres), -1, np.int64)
            if swap:
                first[wb] = na.centres[wa]
            else:
                first[wa] = nb.centres[wb]
            own = np.flatnonzero(inside)
            links.append((first[side.of[own]], own) if swap else (own, first[side.of[own]]))
    next_a.append(ca[open_])
    next_b.append(cb[open_])


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row."""
    return F.transform(F.array(value), use)[0]


def _unit(v: np.ndarray) -> np.ndarray:
    """Vectors scaled to unit length, by their largest component first, as ``_unit_classes`` does."""
    if not len(v):
        return v
    v = v / np.abs(v).max(1)[:, None]
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _unit_classes(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep, w) and classes (rep, w, v, d) of valid vectors that are equal when scaled to unit length; v is one of them as it came."""
    given = "array<float>" if rows.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    raw = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(given).alias("given"), F.col(vec_col).cast("array<double>").alias("v"))
    valid = raw.where("id is not null and v is not null and size(v) > 0").where(~F.exists("v", F.isnull))
    valid = valid.withColumn("largest", F.array_max(F.transform("v", F.abs))).where("largest > 0 and not isnan(largest) and largest < double('infinity')")
    # by the largest component first: squares of very large or small ones leave the range of a double
    even = _with(F.col("largest"), lambda largest: F.transform("v", lambda c: c / largest))
    unit = _with(even, lambda v: _with(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c)), lambda norm: F.transform(v, lambda c: c / norm)))
    hashed = valid.select("id", "given", unit.alias("x")).select("id", "given", F.xxhash64("x").alias("h1"), F.hash("x").alias("h2"))
    classes = stash(hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("given").alias("v")), "vector-classes")
    members = stash(hashed.select("id", "h1", "h2").join(classes.select("h1", "h2", "rep", "w"), ["h1", "h2"]).select("id", "rep", "w"), "vectors")
    return members, classes.select("rep", "w", "v", F.size("v").alias("d"))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    members, classes = _unit_classes(rows, id_col, vec_col)
    sizes = classes.groupBy("d").agg(F.count("*").alias("n")).collect()  # one row for each length of vectors
    counts, edges = [], []
    for d, n in sizes:
        c, e = _near_of_length(classes.where(F.col("d") == d), n, cosine)
        counts.append(c)
        edges.append(e)
    discard(classes)
    none = spark.createDataFrame([], "rep long, n long"), spark.createDataFrame([], "a long, b long")
    count, edge = none
    for c, e in zip(counts, edges, strict=True):
        count, edge = count.union(c), edge.union(e)
    linked = connected_components(edge)
    by_rep = members.join(count.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(linked.withColumnRenamed("id", "rep"), "rep", "left")
    found = by_rep.select("id", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # rows that share an id stay rows; each takes its id's least component and largest count
    found = found.groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = rows.select(F.col(id_col), F.col(id_col).cast("long").alias("id"))
    out = ids.join(found, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col(f"`{id_col}`"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _near_of_length(classes: DataFrame, n: int, cosine: float) -> tuple[DataFrame, DataFrame]:
    spark = classes.sparkSession
    reach = float(np.sqrt(2 - 2 * cosine))
    # twice as many rows as are wanted reach the last step of the limit, whatever the number of tasks
    share = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(max(1, n // (2 * SAMPLE_ROWS)))) == 0
    sample = _unit(_matrix(classes.where(share).orderBy(F.xxhash64("rep")).limit(SAMPLE_ROWS).select("v").toArrow()["v"]))
    pivots = spark.sparkContext.broadcast(_pivots(sample, int(min(MAX_PIVOTS, max(1, -(-n // CELL_ROWS))))))
    kind = classes.schema["v"].dataType.simpleString()
    width = np.float32 if kind == "array<float>" else np.float64

    def nearest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        cos = _unit(_matrix(batch.column("v"))) @ pivots.value.T if batch.num_rows else np.zeros((0, 1))
        own = cos.argmax(1)
        return own, np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(cos)), own]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, far = nearest(batch)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(far)], ["pivot", "far"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("rep", "w", "v")], pa.array(nearest(batch)[0], pa.int32())], ["rep", "w", "v", "pivot"])

    rows = classes.select("rep", "w", "v")
    cells = rows.mapInArrow(measure, "pivot int, far double").groupBy("pivot").agg(F.count("*").alias("m"), F.max("far").alias("radius")).collect()  # at most MAX_PIVOTS rows
    radius = {r.pivot: r.radius for r in cells}
    parts = {r.pivot: -(-r.m // CELL_ROWS) for r in cells}
    first, total = {}, 0
    for p in sorted(parts):
        first[p], total = total, total + parts[p]
    lookup = F.create_map(*[F.lit(v) for p in sorted(parts) for v in (p, first[p])])
    many = F.create_map(*[F.lit(v) for p in sorted(parts) for v in (p, parts[p])])
    placed = rows.mapInArrow(assign, f"rep long, w long, v {kind}, pivot int")
    celled = placed.withColumn("cell", (lookup[F.col("pivot")] + F.pmod(F.xxhash64("rep"), many[F.col("pivot")])).cast("int"))
    p = pivots.value
    between = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))
    within = {k: [q for q in radius if between[k, q] <= radius[k] + radius[q] + reach + _EPS] for k in radius}

    def grow(table: pa.Table) -> pa.Table:
        v, pivot = _matrix(table["v"]), table["pivot"][0].as_py()
        packed = [table["rep"].to_numpy(), table["w"].to_numpy().astype(np.float64), v.astype(width), cover_paths(_unit(v)).astype(np.int32)]
        data = {name: pa.array([x.tobytes()], pa.binary()) for name, x in zip(("reps", "w", "v", "path"), packed, strict=True)}
        return pa.table({"cell": pa.array([table["cell"][0].as_py()], pa.int32()), "pivot": pa.array([pivot], pa.int32()), "within": pa.array([within[pivot]], pa.list_(pa.int32())), **data})

    trees = stash(celled.groupBy("cell").applyInArrow(grow, "cell int, pivot int, within array<int>, reps binary, w binary, v binary, path binary"), "trees")

    def side(row: dict) -> tuple[np.ndarray, ...]:
        reps, w = np.frombuffer(row["reps"], np.int64), np.frombuffer(row["w"], np.float64)
        v, path = np.frombuffer(row["v"], width).astype(np.float64).reshape(len(reps), -1), np.frombuffer(row["path"], np.int32)
        return reps, w, _unit(v), path.reshape(len(reps), -1).astype(np.int64)

    def facing(own: tuple[np.ndarray, ...], at: int, other: int) -> tuple[np.ndarray, ...]:
        """The vectors of a cell of pivot ``at`` that may be near one of pivot ``other``'s."""
        reps, w, x, path = own
        if at == other:
            return own
        from_at, from_other = x @ pivots.value[at], x @ pivots.value[other]
        near = from_at - from_other <= reach * between[at, other] + _EPS
        near &= np.sqrt(np.maximum(0, 2 - 2 * from_other)) <= radius[other] + reach + _EPS
        return own if near.all() else (reps[near], w[near], x[near], _renumber(path[near]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = ({k: row[f"{s}_{k}"] for k in ("pivot", "reps", "w", "v", "path")} for s in ("low", "high"))
                same = row["low_cell"] == row["high_cell"]
                a = facing(side(low), low["pivot"], high["pivot"])
                b = a if same else facing(side(high), high["pivot"], low["pivot"])
                if not len(a[0]) or not len(b[0]):
                    continue
                (ra, wa, xa, pa_), (rb, wb, xb, pb) = a, b
                na, nb, i, j = dual_traversal(xa, wa, pa_, xb, wb, pb, cosine)
                reps, n = (ra, na - wa) if same else (np.concatenate([ra, rb]), np.concatenate([na, nb]))
                x, y = _forest(ra[i], rb[j]) if len(i) else (np.zeros(0, np.int64),) * 2
                some = n > 0.5
                ends = pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(y, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([reps[some], x])), ends, pa.array(np.concatenate([np.rint(n[some]).astype(np.int64), np.zeros(len(x), np.int64)]))], ["a", "b", "n"])

    low, high = (trees.select(*[F.col(c).alias(f"{s}_{c}") for c in trees.columns]) for s in ("low", "high"))
    pairs = low.hint("shuffle_replicate_nl").join(high, (F.col("low_cell") <= F.col("high_cell")) & F.array_contains("low_within", F.col("high_pivot")))
    with _records(spark, _PAIRS):
        met = stash(pairs.mapInArrow(meet, "a long, b long, n long"), "near")
    discard(trees)
    return met.where("b is null").select(F.col("a").alias("rep"), "n"), met.where("b is not null").select("a", "b")


@contextlib.contextmanager
def _records(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most ``n`` rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _renumber(path: np.ndarray) -> np.ndarray:
    """Centres as indexes into the rows at hand: the first member that came stands for the centre, which may have stayed away."""
    out = path.copy()
    for level in range(path.shape[1]):
        _, at, of = np.unique(path[:, level], return_index=True, return_inverse=True)
        out[:, level] = at[of]
    return out
