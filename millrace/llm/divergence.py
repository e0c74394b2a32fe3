"""Divergence of sources: how the word frequencies of the sources of one language differ, pair by pair and term by term.

Tasks count terms over blocks of texts and send on (language, source, term, count, documents); Spark adds these up. A
language keeps the terms that enough of its documents hold, dealt to blocks by hash. Each block of terms makes a dense int64 tile,
one row for each source and one column for each term, in which all pairs of rows are compared by broadcasting. Sums over the block
make a partial matrix of pairs, and each source keeps a heap of its most divergent terms; Spark adds up the matrices and merges the heaps.
Sources are dealt to chunks, and a tile compares two chunks, so that a tile stays small with many sources.

All arithmetic runs over whole numbers. A share of 1,000,000,000 is found digit group by digit group, so that no product leaves 64 bits:
counts may reach 9 * 10 ** 15.

Defined results: a null text, language or source counts as empty; every row is a document of its own, repeated or not, whatever its id; a source
without terms of a language that keeps some gives each the same share; a language that keeps no term gives pairs of value 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.shared import frugal, small_or_shuffled, stash
from millrace.llm.textblocks import span_hashes

#: Bytes of text that a task counts at a time.
COUNT_BYTES = 4_000_000
#: Terms of a tile, on average, and sources of a chunk; a tile has one or two chunks.
BLOCK_TERMS = 4096
CHUNK_SOURCES = 128
SCALE_STEPS = 3  # 1000 ** 3 is the scale of shares
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shares(counts: np.ndarray, total: np.ndarray, n_terms: int) -> np.ndarray:
    """1 + floor(10 ** 9 * (count + 2) / (total + 2 * terms)), exactly."""
    whole = total + 2 * n_terms
    rest, out = counts + 2, np.zeros(np.broadcast_shapes(np.shape(counts), np.shape(total)), np.int64)
    for _ in range(SCALE_STEPS):
        rest = rest * 1000
        digits = rest // whole
        out, rest = out * 1000 + digits, rest - digits * whole
    return out + 1


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / (p + q)), element by element."""
    d = p - q
    return d * d // (p + q)


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of letters within each text."""
    inside = _LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _term_counts(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Group, term, count and number of texts of each term of each group of texts."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = _LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    starts, ends = _spans(data, offsets) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, starts, "right") - 1
    _, example, term = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    order = np.lexsort((row, term, groups[row]))
    g, t, r = groups[row][order], term[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (t[1:] != t[:-1])
    first = new.copy()
    first[1:] |= r[1:] != r[:-1]
    at = np.flatnonzero(new)
    spelled = [data[starts[k] : ends[k]].tobytes() for k in example]
    return g[at], [spelled[k] for k in t[at]], np.diff(np.append(at, len(order))), np.add.reduceat(first.astype(np.int64), at)


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) over all documents: how often a source's documents of a language hold a term, and how many do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("text").cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                begun = ends[at - 1] if at else 0
                end = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, begun + COUNT_BYTES, "right"))))
                some = batch.slice(at, end - at)
                keys = pa.StructArray.from_arrays([some.column("lang"), some.column("source")], ["lang", "source"])
                names = {}
                groups = np.array([names.setdefault((k["lang"], k["source"]), len(names)) for k in keys.to_pylist()], np.int64)
                g, terms, n, n_docs = _term_counts(some.column("text"), groups)
                known = list(names)
                column = lambda k, kind=pa.string(): pa.array([known[x][k] for x in g], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([column(0), column(1), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n), pa.array(n_docs)], ["lang", "source", "term", "n", "n_docs"])
                at = end

    found = docs.select("lang", "source", "text").mapInArrow(frugal(count), "lang string, source string, term string, n long, n_docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def _tile(ranks: int):
    """The function of one block of terms and two chunks of sources: partial sums of pairs, and each source's most divergent terms."""
    schema = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def tile(key: tuple, sources: pa.Table, counts: pa.Table) -> pa.Table:
        own = sources.sort_by("source").to_pydict()
        names, chunks, totals = own["source"], np.array(own["chunk"], np.int64), np.array(own["total"], np.int64)
        if not names:
            return schema.empty_table()
        n_terms, lang_total, lang = own["n_terms"][0], own["lang_total"][0], own["lang"][0]
        # columns in the order of the terms' bytes, so that ties in the heaps fall to the smaller term
        encoded = counts.column("term").combine_chunks().cast(pa.binary()).dictionary_encode()
        if isinstance(encoded, pa.ChunkedArray):
            encoded = encoded.combine_chunks()
        spelled = encoded.dictionary.to_pylist()
        order = sorted(range(len(spelled)), key=spelled.__getitem__)
        column = np.empty(len(spelled), np.int64)
        column[order] = np.arange(len(spelled))
        column = column[encoded.indices.to_numpy(zero_copy_only=False)] if len(spelled) else np.zeros(0, np.int64)
        place = {s: k for k, s in enumerate(names)}
        row = np.array([place[s] for s in counts.column("source").to_pylist()], np.int64)
        grid, of_lang = np.zeros((len(names), len(spelled)), np.int64), np.zeros(len(spelled), np.int64)
        grid[row, column] = counts.column("n").to_numpy()
        of_lang[column] = counts.column("lang_n").to_numpy()
        p = shares(grid, totals[:, None], n_terms) if n_terms else grid
        out: dict[str, list] = {c: [] for c in schema.names}

        def tell(part: str, source: str, items: list, values: list) -> None:
            for c, v in (("part", [part] * len(items)), ("lang", [lang] * len(items)), ("source", [source] * len(items)), ("item", items), ("value", values)):
                out[c].extend(v)

        # terms of the block that no source of these two chunks holds still give each source a share
        absent = own["block_terms"][0] - len(spelled)
        p_absent = shares(np.zeros(len(names), np.int64), totals, n_terms) if absent else totals
        a, b = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(chunks == a), np.flatnonzero(chunks == b)
        for i in left:
            sums = distances(p[i][None, :], p[right]).sum(axis=1)
            if absent:
                sums = sums + absent * distances(p_absent[i], p_absent[right])
            others = [(names[j], int(v)) for j, v in zip(right, sums, strict=True) if (j > i if a == b else True)]
            tell("pair", names[i], [o for o, _ in others], [v for _, v in others])
        if a == b:
            q = shares(of_lang, np.int64(lang_total), n_terms) if n_terms else of_lang
            for i in left:
                at = np.flatnonzero((grid[i] > 0) & (p[i] > q))
                values = distances(p[i][at], q[at])
                best = heapq.nsmallest(ranks, range(len(at)), key=lambda k: (-values[k], at[k]))  # noqa: B023
                tell("term", names[i], [spelled[order[at[k]]].decode() for k in best], [int(values[k]) for k in best])
        return pa.table(out, schema)

    return tile


def source_divergence(docs: DataFrame, min_docs: int = 10, ranks: int = 10, block_terms: int = BLOCK_TERMS, chunk_sources: int = CHUNK_SOURCES) -> DataFrame:
    """(lang, source, part, item, value, rank): of each source of a language its distance to each other source (part pair, all ranks), and the terms of which it has more than the language has (part term, the first ``ranks``)."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    docs = docs.select(text("lang"), text("source"), text("text"))
    counts = stash(count_terms(docs), "term-counts")
    together = Window.partitionBy("lang", "term")
    kept = counts.withColumn("held", F.sum("n_docs").over(together)).withColumn("lang_n", F.sum("n").over(together)).where(F.col("held") >= min_docs)
    kept = stash(kept.select("lang", "source", "term", "n", "lang_n"), "kept-terms")

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_distinct("term").alias("n_terms"))
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("n_rows"))
    sources = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "n_terms"])
    # sources of a language in chunks of about chunk_sources, by hash
    n_sources = F.count("*").over(Window.partitionBy("lang"))
    part_of = lambda n, size: F.greatest(F.lit(1).cast("long"), F.ceil(n / size))
    sources = sources.withColumn("n_chunks", part_of(n_sources, chunk_sources)).withColumn("n_blocks", part_of(F.col("n_terms"), block_terms))
    sources = sources.withColumn("chunk", F.pmod(F.xxhash64("source"), F.col("n_chunks")))
    sources = stash(sources.select("lang", "source", "chunk", "n_chunks", "n_blocks", "total", "lang_total", "n_terms"), "audited-sources")

    # a tile takes the chunks (a, b) with a <= b; a source is in those of its chunk
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("other")
    side = sources.select("*", others).withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
    placed = kept.join(small_or_shuffled(sources).select("lang", "source", "chunk", "n_chunks", "n_blocks"), ["lang", "source"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")))
    sizes = placed.select("lang", "block", "term").distinct().groupBy("lang", "block").agg(F.count("*").alias("block_terms"))
    given = side.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")).join(sizes, ["lang", "block"], "left").na.fill(0, ["block_terms"])
    placed = placed.select("*", others).withColumn("a", F.least("chunk", "other")).withColumn("b", F.greatest("chunk", "other"))
    keys = ["lang", "block", "a", "b"]
    tiles = given.select(*keys, "source", "chunk", "total", "lang_total", "n_terms", "block_terms").groupBy(*keys).cogroup(placed.select(*keys, "source", "term", "n", "lang_n").groupBy(*keys))
    found = stash(tiles.applyInArrow(_tile(ranks), "part string, lang string, source string, item string, value long"), "divergence-tiles")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.unionByName(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = both.withColumn("rank", F.row_number().over(order))
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*columns).union(terms.select(*columns))
