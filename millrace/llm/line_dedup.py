"""Corpus-wide removal of lines that many documents share.

A first pass over the texts fills two Bloom filters (once seen, twice seen) with the
hashes of each document's distinct long line keys. A second pass sends on only lines
whose hash may have been seen twice: these are counted exactly by their whole key, and
the document that keeps the line is chosen. A third pass rebuilds the texts.

Defined results: a null or empty text is one empty line; equal lines within a document
count once; rows that share a doc_id count as documents of their own and all keep a line
that the largest doc_id keeps; a null doc_id sorts below all others; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import discard, frugal, stash
from millrace.llm.textblocks import TextBlock, blocks
from millrace.llm.twice_filter import MAX_BITS, build_twice_filter, filter_bits, suspected

STRIPPED = b" \t\n\x0b\x0c\r"


def _keys(block: TextBlock, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the stripped lines of at least ``min_chars`` code points, their rows and their hashes without case."""
    starts, ends, rows = block.lines()
    a, b = np.searchsorted(block.starts, starts), np.searchsorted(block.ends, ends, "right")
    some = b > a  # a line of white space only is shorter than any key
    starts, ends, rows = block.starts[a[some]], block.ends[b[some] - 1], rows[some]
    chars = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=chars[1:])
    long = chars[ends] - chars[starts] >= max(1, min_chars)
    starts, ends, rows = starts[long], ends[long], rows[long]
    return starts, ends, rows, block.span_hashes(starts, ends, lower=True)


def _first_of_row(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Indexes of one of each (row, hash)."""
    order = np.lexsort((hashes, rows))
    new = np.ones(len(order), bool)
    new[1:] = (rows[order][1:] != rows[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return order[new]


def shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """(key_hash binary, key, n_docs, keeper) of each line key of ``min_chars`` code points or more that ``min_docs`` documents or more hold; ``keeper`` is the largest id."""
    return _shared(_suspects(docs, id_col, text_col, min_chars, max_bits), min_docs)


def _suspects(docs, id_col, text_col, min_chars, max_bits) -> DataFrame:
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).alias("n")).first().n or 1

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in blocks(batch.column("text")):
            *_, rows, found = _keys(block, min_chars)
            yield found[_first_of_row(rows, found)]

    twice = texts.sparkSession.sparkContext.broadcast(build_twice_filter(texts.select("text"), hashes, filter_bits(n_lines, max_bits)))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                starts, ends, rows, found = _keys(block, min_chars)
                keep = _first_of_row(rows, found)
                keep = keep[suspected(twice.value, found[keep])]
                keys = [block.data[s:e].tobytes().lower() for s, e in zip(starts[keep], ends[keep], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows[keep] + block.first)), pa.array(keys, pa.binary())], ["id", "key"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("key", T.BinaryType())])
    return texts.mapInArrow(frugal(repeated), schema)


def _shared(suspects: DataFrame, min_docs: int) -> DataFrame:
    return suspects.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("id").alias("keeper")).where(F.col("n_docs") >= min_docs)


def drop_shared_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """The input with shared lines taken out of ``text_col``, and ``n_lines`` (before) and ``n_dropped`` added."""
    suspects = stash(_suspects(docs, id_col, text_col, min_chars, max_bits), "suspect-lines")
    # written, as Spark splits the hot keys of a join of two tables, not those of a join with an aggregate
    shared = stash(_shared(suspects, min_docs).select("key", "keeper"), "shared-lines")
    lost = suspects.join(shared, "key").where(~F.col("id").eqNullSafe(F.col("keeper")))
    lost = stash(lost.groupBy("id").agg(F.collect_set("key").alias("lost_keys")), "lost-lines")
    discard(suspects, shared)
    row = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns if c != text_col])
    joined = docs.alias("d").join(lost.alias("l"), F.col(f"d.`{id_col}`").eqNullSafe(F.col("l.id")), "left").select(row.alias("row"), F.col(f"d.`{text_col}`").alias("text"), F.col("l.lost_keys").alias("lost_keys"))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            out, n_lines, n_dropped = [], [], []
            for text, lost_keys in zip(texts, batch.column("lost_keys").to_pylist(), strict=True):
                lines = (text or "").encode().split(b"\n")
                kept = lines
                if lost_keys:
                    gone = set(lost_keys)
                    kept = [x for x in lines if x.strip(STRIPPED).lower() not in gone]
                out.append(b"\n".join(kept).decode() if text is not None else None)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], ["row", "new_text", "n_lines", "n_dropped"])

    fields = [T.StructField("row", joined.schema["row"].dataType), T.StructField("new_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    rebuilt = joined.mapInArrow(frugal(rebuild), T.StructType(fields))
    own = [F.col("new_text").alias(text_col) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rebuilt.select(*own, "n_lines", "n_dropped")


def line_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped and the digest of the text that stays."""
    out = drop_shared_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
