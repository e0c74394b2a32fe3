"""Removal of passages that an earlier document holds, by FM-indexes over shards of shared text.

A window is ``size`` consecutive words. Its anchor is the least hash of the runs of ``ANCHOR``
words in it, so equal windows have equal anchors wherever they stand. Consecutive windows of one anchor are a segment.

1. The distinct anchors of each document fill a pair of Bloom filters; a segment whose anchor cannot have
   been seen in two documents is dropped. (A false suspicion costs work only.)
2. Equal segments become one, with the smallest id among their documents, before they are dealt to shards by their anchor.
   A shard holds about ``SHARD_WORDS`` words.
3. In each shard an FM-index is built over the segments, and all segments are streamed against
   it: backward search gives matching statistics, and of each match of ``size`` words the smallest id in its interval.
4. Anchors with more than ``CROWD`` different segments (a passage between many different neighbours) would fill a
   shard alone: their windows are grouped by content instead.
5. Every document gets back the windows whose smallest id is below its own; the covered words go.

Defined results: null, empty and wordless texts have no words; fewer words than a window are never removed; rows that
share an id are judged each by itself and don't remove from each other; a null id counts as
smaller than all others; an empty table gives an empty result. Columns named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.fm_index import FmIndex
from millrace.llm.shared import discard, frugal, small_or_shuffled, stash
from millrace.llm.textblocks import TextBlock, blocks, mix, powers, windows
from millrace.llm.twice_filter import MAX_BITS, build_twice_filter, filter_bits, suspected

#: Words of an anchor; windows of a segment at most.
ANCHOR, RUN = 5, 64
#: Words of a shard, beyond which it ends with its anchor; and shards of a task for each of Spark's shuffle partitions.
SHARD_WORDS, TASKS = 400_000, 8
CROWD = 3000
#: Bytes of a word's hash in a segment's words. Windows are equal if all their words' hashes are.
WORD_BYTES = 6
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEAST_ID = -(1 << 63)


class Segments:
    """The segments of a block of texts: first word, windows, anchor and row of each."""

    def __init__(self, block: TextBlock, size: int):
        self.block, self.size, self.words = block, size, block.word_hashes()
        width = min(ANCHOR, size)
        gram, at = windows(self.words, block.word_row, width)
        least = np.full(len(self.words) + 1, _MAX, np.uint64)
        least[at] = gram
        span, have = size - width + 1, 1
        while have < span:  # sliding minimum by doubling
            step = min(have, span - have)
            moved = np.full(len(least), _MAX, np.uint64)
            moved[: len(least) - step] = least[step:]
            least, have = np.minimum(least, moved), have + step
        n = len(self.words) - size + 1
        first = np.flatnonzero(block.word_row[:n] == block.word_row[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        anchor = least[first]
        new = np.ones(len(first), bool)
        new[1:] = (first[1:] != first[:-1] + 1) | (anchor[1:] != anchor[:-1])
        begins = np.flatnonzero(new)
        run = np.arange(len(first)) - np.repeat(begins, np.diff(np.append(begins, len(first))))
        begins = np.flatnonzero(run % RUN == 0)
        self.start, self.anchor = first[begins], anchor[begins]
        self.n = np.diff(np.append(begins, len(first)))
        self.row = block.word_row[self.start]

    def distinct_anchors(self) -> np.ndarray:
        order = np.lexsort((self.anchor, self.row))
        a, r = self.anchor[order], self.row[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
        return a[new]

    def keep(self, which: np.ndarray) -> None:
        self.start, self.anchor, self.n, self.row = self.start[which], self.anchor[which], self.n[which], self.row[which]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each segment's words."""
        return _span_hashes(self.words, self.start, self.start + self.n + self.size - 1)


def _span_hashes(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    power, inverse = powers(len(words) + 1)
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ np.uint64(salt)) * power[:-1], out=sums[1:])
        out.append(mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64)))
    return out[0], out[1]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _packed(words: np.ndarray, n: np.ndarray) -> pa.Array:
    """Runs of word hashes as bytes, ``WORD_BYTES`` a word, which is most of what is shuffled."""
    data = words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()
    offsets = (np.append(0, np.cumsum(n)) * WORD_BYTES).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all rows of a packed column, and how many each row has."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].reshape(-1, WORD_BYTES)
    words = np.zeros((len(data), 8), np.uint8)
    words[:, :WORD_BYTES] = data
    return words.view("<u8").ravel(), np.diff(offsets) // WORD_BYTES


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(flat))


def _ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them) for each start."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


class _Shard:
    """Segments that one task holds."""

    def __init__(self, table: pa.Table):
        packed = table["words"].combine_chunks()
        self.flat, self.n = _unpacked(packed.combine_chunks() if isinstance(packed, pa.ChunkedArray) else packed)
        self.doc = table["doc"].to_numpy()

    def search(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For each window of all segments in a row: the smallest id of a segment that holds it; and where each segment's windows begin."""
        begin = np.cumsum(self.n) - self.n
        _, dense = np.unique(self.flat, return_inverse=True)
        # 0 ends the text and 1 ends a segment
        text = np.ones(len(self.flat) + len(self.n), np.int64)
        place = _ragged(begin + np.arange(len(self.n)), self.n)
        text[place] = dense + 2
        labels = np.repeat(self.doc, self.n + 1)
        index = FmIndex(text, labels, int(text.max(initial=1)) + 1)
        many = self.n - size + 1
        ends = _ragged(begin + np.arange(len(self.n)) + size - 1, many)
        length, low, high = index.matching_statistics(text, ends, size, lone=False)
        out = np.repeat(self.doc, many)
        full = length == size
        out[full] = index.least_label(low[full], high[full])
        return out, np.append(0, np.cumsum(many))


def repeated_words(docs: DataFrame, id_col: str, text_col: str, size: int, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, tag, spans), written: for each document that loses words, its id, a hash of its text, and the spans of word numbers covered by windows of a smaller id."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)).alias("id"), F.col(text_col).alias("text")).where("text is not null").withColumn("tag", F.xxhash64("text"))
    context = texts.sparkSession.sparkContext
    # about one anchor for four words of six bytes, with eight bits each
    n_bytes = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for block in blocks(batch.column("text")):
            yield Segments(block, size).distinct_anchors()

    twice = context.broadcast(build_twice_filter(texts.select("text"), anchors, filter_bits(n_bytes // 48, max_bits)))

    def emit(batches: Iterator[pa.RecordBatch], with_words: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            for block in blocks(batch.column("text")):
                s = Segments(block, size)
                s.keep(suspected(twice.value, s.anchor))
                h1, h2 = s.hashes()
                for k in range(0, len(h1), 50_000):
                    part = slice(k, k + 50_000)
                    doc = pa.array(ids[block.first + s.row[part]])
                    if with_words:
                        n = s.n[part] + size - 1
                        words = _packed(s.words[_ragged(s.start[part], n)], n)
                        yield pa.RecordBatch.from_arrays([_signed(h1[part]), _signed(h2[part]), _signed(s.anchor[part]), doc, words], ["h1", "h2", "anchor", "doc", "words"])
                    else:
                        at = s.start[part] - block.word_offsets[s.row[part]]
                        yield pa.RecordBatch.from_arrays([_signed(h1[part]), _signed(h2[part]), doc, pa.array(tags[block.first + s.row[part]]), pa.array(at), pa.array(s.n[part])], ["h1", "h2", "doc", "tag", "at", "n"])

    found = texts.mapInArrow(frugal(lambda b: emit(b, True)), "h1 long, h2 long, anchor long, doc long, words binary")
    segments = found.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"), F.first("anchor").alias("anchor"), F.first("words").alias("words"))
    segments = stash(segments, "segments")
    crowded = stash(segments.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > CROWD).select("anchor"), "crowded-anchors")
    crowded = small_or_shuffled(crowded)  # few: the segments need no shuffle to find theirs
    usual = segments.join(crowded, "anchor", "left_anti")
    total_bytes = segments.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0

    # a task builds shard after shard, so their number doesn't bring as many tasks
    parts = max(1, min(-(-total_bytes // (WORD_BYTES * SHARD_WORDS)), TASKS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Rows of whole anchors, which come in order."""
        held, words = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor = batch.column("anchor").to_numpy()
            if words > SHARD_WORDS:
                new = np.flatnonzero(anchor != held[-1].column("anchor")[-1].as_py())
                if len(new):
                    yield pa.Table.from_batches([*held, batch.slice(0, int(new[0]))])
                    batch, held, words = batch.slice(int(new[0])), [], 0
            held.append(batch)
            words += pc.sum(pc.binary_length(batch.column("words"))).as_py() // WORD_BYTES
        if held:
            yield pa.Table.from_batches(held)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shards(batches):
            yield from search(table)

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = _Shard(table)
        least, begin = own.search(size)
        doc, last = own.doc, table["last"].to_numpy()
        lower = np.minimum.reduceat(least, begin[:-1]) < doc
        some = np.flatnonzero(lower | (last > doc))
        n = np.diff(begin)[some]
        flat = least[_ragged(begin[:-1][some], n)]
        take = pa.array(some)
        for k in range(0, len(some), 50_000):
            part = slice(k, k + 50_000)
            edges = np.append(0, np.cumsum(n))
            yield pa.RecordBatch.from_arrays([table["h1"].take(take[part]).combine_chunks(), table["h2"].take(take[part]).combine_chunks(), pa.array(np.zeros(len(n[part]), np.int64)), _lists(flat[edges[k] : edges[min(len(n), k + 50_000)]], n[part])], ["h1", "h2", "shift", "least"])

    results = usual.select("h1", "h2", "doc", "last", "words", "anchor").repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(frugal(shard), "h1 long, h2 long, shift long, least array<long>")
    windows_of_crowds = _crowded_windows(segments.join(crowded, "anchor", "left_semi"), size)
    results = stash(results.unionByName(windows_of_crowds), "least")
    discard(segments, crowded, windows_of_crowds)  # the results are written, and take their place on disk
    seen = texts.mapInArrow(frugal(lambda b: emit(b, False)), "h1 long, h2 long, doc long, tag long, at long, n long")
    met = seen.join(results, ["h1", "h2"])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("least")
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            least, n = lists.flatten().to_numpy(), np.diff(offsets)
            row = np.repeat(np.arange(len(n)), n)
            window = np.arange(len(least)) - np.repeat(offsets[:-1], n) + (batch.column("at").to_numpy() + batch.column("shift").to_numpy())[row]
            gone = np.flatnonzero(least < batch.column("doc").to_numpy()[row])
            row, window = row[gone], window[gone]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1] + 1)
            begins = np.flatnonzero(new)
            stops = np.append(begins[1:], len(row))[: len(begins)] - 1
            take = pa.array(row[begins])
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(take), batch.column("tag").take(take), pa.array(window[begins]), pa.array(window[stops] + size)], ["id", "tag", "begin", "stop"])

    covered = met.mapInArrow(frugal(spans), "id long, tag long, begin long, stop long")
    # at most one span for each segment of one document
    out = stash(covered.groupBy("id", "tag").agg(F.collect_list(F.struct("begin", "stop")).alias("spans")), "spans")
    discard(results)
    twice.destroy()
    return out


def _crowded_windows(segments: DataFrame, size: int) -> DataFrame:
    """The least id of every window of these segments, by grouping the windows themselves; only windows of several ids come back."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = _unpacked(batch.column("words"))
            offsets = np.append(0, np.cumsum(n))
            many = n - size + 1
            start = _ragged(offsets[:-1], many)
            row = np.repeat(np.arange(len(n)), many)
            w1, w2 = _span_hashes(flat, start, start + size)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("h1", "h2", "doc", "last")], pa.array(start - offsets[row]), _signed(w1), _signed(w2)], ["h1", "h2", "doc", "last", "shift", "w1", "w2"])

    rows = stash(segments.select("h1", "h2", "doc", "last", "words").mapInArrow(frugal(split), "h1 long, h2 long, doc long, last long, shift long, w1 long, w2 long"), "crowded")
    least = rows.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("last").alias("last")).where("least < last").drop("last")
    return rows.join(least, ["w1", "w2"]).select("h1", "h2", "shift", F.array("least").alias("least"))


def drop_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13, max_bits: int = MAX_BITS) -> DataFrame:
    """The input without the words covered by windows that also start in a document of a smaller id; ``n_words`` (before) and ``n_removed`` are added.

    A removed run of words goes with the white space up to the next kept word.
    """
    spans = repeated_words(docs, id_col, text_col, size, max_bits)
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed") or c in (id_col, text_col)]
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != text_col])
    keyed = docs.select(row.alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST_ID)).alias("id"), F.xxhash64(text_col).alias("tag"))
    joined = keyed.join(spans, ["id", "tag"], "left").select("row", "text", "spans")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lost = batch.column("spans")
            out, n_words, n_removed = batch.column("text").to_pylist(), [], []
            for block in blocks(batch.column("text")):
                n_words += block.n_words.tolist()
                for k in range(block.rows):
                    found = lost[block.first + k]
                    if not found.is_valid:
                        n_removed.append(0)
                        continue
                    gone = np.zeros(int(block.n_words[k]), bool)
                    for s in found.as_py():
                        gone[s["begin"] : s["stop"]] = True
                    n_removed.append(int(gone.sum()))
                    out[block.first + k] = _without(block, k, gone)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["row", "new_text", "n_words", "n_removed"])

    fields = [T.StructField("row", keyed.schema["row"].dataType), T.StructField("new_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    rebuilt = joined.mapInArrow(frugal(rebuild), T.StructType(fields))
    return rebuilt.select(*[F.col("new_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns], "n_words", "n_removed")


def _without(block: TextBlock, row: int, gone: np.ndarray) -> str:
    first = block.word_offsets[row]
    starts = np.append(block.starts[first : first + len(gone)], block.offsets[row + 1])
    edge = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    parts, at = [], block.offsets[row]
    for b, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        parts.append(block.data[at : starts[b]].tobytes())
        at = starts[e]
    parts.append(block.data[at : block.offsets[row + 1]].tobytes())
    return b"".join(parts).decode()


def passage_digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed and the digest of its kept words, joined by one space."""
    out = drop_repeated_passages(docs.select("doc_id", "text"))
    space = F.lit(" \t\n\x0b\x0c\r")
    words = F.regexp_replace(F.btrim(F.coalesce("text", F.lit("")), space), r"[\x20\x09-\x0D]+", " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))
