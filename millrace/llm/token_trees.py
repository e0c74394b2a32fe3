"""Token counts that follow edits: per document a tree over its pre-tokens, of which an edit touches a few leaves.

A byte-level BPE tokenizer splits a text into pre-tokens and encodes each by itself, so a
document's count is a sum over pre-tokens. ``TokenTree`` keeps their lengths and counts in leaves, with
sums of characters and tokens in the inner nodes. An edit scans again from a boundary that lies
before everything the edit can influence, up to the first old boundary behind the edit at which old and new splits
meet; only the pre-tokens between are encoded, and only their leaves' sums are updated.

Defined results: a null text is empty; edits apply in the given order, each to the result of the one before; an edit
that is null changes nothing, places and lengths outside the text are moved to its ends, a null
insertion is empty; repeated rows are counted each by itself; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import frugal

#: How far beyond its end a pre-token depends on the text (a contraction, or white space before a word).
CONTEXT = 2
#: Pre-tokens of a leaf when a tree is built, and when a leaf is split.
LEAF, FULL = 64, 192
CACHED = 300_000


class PreTokens:
    """Splits texts and counts the tokens of pre-tokens; made once for each worker process."""

    def __init__(self, ranks_path: str, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(ranks_path, "rb"))}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.young.get(piece)
        if n is None:
            n = self.old.get(piece) or len(self.encoding.encode_ordinary(piece))
            self.young[piece] = n
            if len(self.young) > CACHED:
                self.old, self.young = self.young, {}
        return n

    def split(self, text: str) -> tuple[list[int], list[int]]:
        """Lengths and token counts of the pre-tokens of a text."""
        pieces = self.pattern.findall(text)
        known = list(map(self.young.get, pieces))
        if None in known:
            known = [self.count(p) if n is None else n for p, n in zip(pieces, known, strict=True)]
        return list(map(len, pieces)), known


class TokenTree:
    """``tokens`` is the count of the whole text; ``edit`` changes the text; ``encoded`` counts the characters that edits had encoded again."""

    def __init__(self, splitter: PreTokens, text: str, lengths: list[int] | None = None, counts: list[int] | None = None):
        self.splitter, self.text, self.encoded = splitter, text, 0
        if lengths is None or counts is None:
            lengths, counts = splitter.split(text)
        self.leaves = [(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)] or [([], [])]
        self._build()

    def _build(self) -> None:
        self.size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.sums = [0] * (2 * self.size), [0] * (2 * self.size)
        for k, (lengths, counts) in enumerate(self.leaves):
            self.chars[self.size + k], self.sums[self.size + k] = sum(lengths), sum(counts)
        for k in range(self.size - 1, 0, -1):
            self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]

    def _update(self, leaf: int) -> None:
        k = self.size + leaf
        lengths, counts = self.leaves[leaf]
        self.chars[k], self.sums[k] = sum(lengths), sum(counts)
        while k > 1:
            k //= 2
            self.chars[k], self.sums[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return self.sums[1]

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and the leaf's first character."""
        k, begin = 1, 0
        while k < self.size:
            k *= 2
            if place >= begin + self.chars[k] and self.chars[k + 1]:
                begin += self.chars[k]
                k += 1
        return k - self.size, begin

    def pieces(self) -> tuple[list[int], list[int]]:
        return [n for lengths, _ in self.leaves for n in lengths], [n for _, counts in self.leaves for n in counts]

    def edit(self, at: int, delete: int, insert: str) -> None:
        at = min(max(0, at), len(self.text))
        delete = min(max(0, delete), len(self.text) - at)
        if not delete and not insert:
            return
        text = self.text[:at] + insert + self.text[at + delete :]
        moved = len(insert) - delete
        # the first boundary to scan from: of the last pre-token whose end lies CONTEXT or more before the edit
        leaf, begin = self._leaf_at(max(0, at - CONTEXT))
        ends = _ends(begin, self.leaves[leaf][0])
        inside = bisect_right(ends, at - CONTEXT)
        start = ends[inside - 1] if inside else begin
        if not inside and begin > at - CONTEXT:
            start, inside = begin, 0
        # old boundaries behind the edit, leaf by leaf, as they are needed
        old_leaf, old_at, old_begin = leaf, inside, start
        new_lengths, new_counts, place = [], [], start
        for found in self.splitter.pattern.finditer(text, start):
            if place >= at + len(insert):
                while old_begin + moved < place and old_leaf < len(self.leaves):
                    old_leaf, old_at, old_begin = self._next(old_leaf, old_at, old_begin)
                if old_begin + moved == place and old_begin >= at + delete:
                    break
            new_lengths.append(found.end() - found.start())
            new_counts.append(self.splitter.count(found.group()))
            place = found.end()
        else:
            old_leaf, old_at = len(self.leaves), 0
        self.encoded += place - start
        self.text = text
        self._replace(leaf, inside, old_leaf, old_at, new_lengths, new_counts)

    def _next(self, leaf: int, at: int, begin: int) -> tuple[int, int, int]:
        lengths = self.leaves[leaf][0]
        if at < len(lengths):
            begin += lengths[at]
            at += 1
        while leaf < len(self.leaves) and at >= len(self.leaves[leaf][0]):
            leaf, at = leaf + 1, 0
        return leaf, at, begin

    def _replace(self, leaf: int, at: int, to_leaf: int, to_at: int, lengths: list[int], counts: list[int]) -> None:
        """Put pre-tokens in place of those from (leaf, at) up to (to_leaf, to_at)."""
        first = self.leaves[leaf]
        tail = ([], []) if to_leaf >= len(self.leaves) else (self.leaves[to_leaf][0][to_at:], self.leaves[to_leaf][1][to_at:])
        merged = tuple(a[:at] + b + c for a, b, c in zip(first, (lengths, counts), tail, strict=True))
        if to_leaf <= leaf or to_leaf == leaf + 1 and to_leaf >= len(self.leaves):
            self.leaves[leaf] = merged
            if len(merged[0]) <= FULL:
                self._update(leaf)
                return
            last = leaf
        else:
            last = min(to_leaf, len(self.leaves) - 1)
        self.leaves[leaf : last + 1] = [(merged[0][k : k + LEAF], merged[1][k : k + LEAF]) for k in range(0, len(merged[0]), LEAF)] or [([], [])]
        self._build()


def _ends(begin: int, lengths: list[int]) -> list[int]:
    out = []
    for n in lengths:
        begin += n
        out.append(begin)
    return out


_splitters: dict[tuple[str, str], PreTokens] = {}


def splitter(ranks_path: str, pattern: str) -> PreTokens:
    key = ranks_path, pattern
    if key not in _splitters:
        _splitters[key] = PreTokens(*key)
    return _splitters[key]


def count_trees(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, text, n_tokens, lengths, counts): the leaves of every document's tree, to be stored and edited later."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(ranks_path, pattern)
        for batch in batches:
            split = [own.split(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text"), pa.array([sum(c) for _, c in split], pa.int64()), pa.array([n for n, _ in split], pa.list_(pa.int32())), pa.array([c for _, c in split], pa.list_(pa.int32()))],
                ["id", "text", "n_tokens", "lengths", "counts"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(frugal(build), f"id {kind}, text string, n_tokens long, lengths array<int>, counts array<int>")
    return out.withColumnRenamed("id", id_col)


def apply_edits(trees: DataFrame, ranks_path: str, pattern: str, edits_col: str = "edits", id_col: str = "doc_id") -> DataFrame:
    """Trees after their edits, with ``tokens_before`` and ``chars_encoded``; ``edits_col`` is an array of (at, delete, insert), as a join with grouped edits gives it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text, lengths, counts, edits in zip(*[batch.column(c) for c in ("text", "lengths", "counts", "edits")], strict=True):
                tree, before = _edited(own, text.as_py() or "", edits.as_py(), lengths.as_py(), counts.as_py())
                rows.append((tree.text, tree.tokens, *tree.pieces(), before, tree.encoded))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], ["id", "text", "n_tokens", "lengths", "counts", "tokens_before", "chars_encoded"])

    kind = trees.schema[id_col].dataType.simpleString()
    out = trees.select(F.col(id_col).alias("id"), "text", "lengths", "counts", F.col(edits_col).alias("edits"))
    return out.mapInArrow(frugal(run), f"id {kind}, text string, n_tokens long, lengths array<int>, counts array<int>, tokens_before long, chars_encoded long").withColumnRenamed("id", id_col)


def _edited(own: PreTokens, text: str, edits: list | None, lengths=None, counts=None) -> tuple[TokenTree, int]:
    tree = TokenTree(own, text, lengths, counts)
    before = tree.tokens
    for e in edits or ():
        if e is not None:
            tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
    return tree, before


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """(id_col, n_chars, n_tokens, n_tokens_edited, chars_encoded): both steps in one pass, where trees need not be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = splitter(ranks_path, pattern)
        for batch in batches:
            rows = []
            for text, edits in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree, before = _edited(own, text.as_py() or "", edits.as_py())
                rows.append((len(tree.text), before, tree.tokens, tree.encoded))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), pa.int64()) for c in columns]], ["id", "n_chars", "n_tokens", "n_tokens_edited", "chars_encoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))
    return out.mapInArrow(frugal(run), f"id {kind}, n_chars long, n_tokens long, n_tokens_edited long, chars_encoded long").withColumnRenamed("id", id_col)


def sample_edits(id_col: str = "doc_id", text_col: str = "text"):
    """Three edits for each document, placed by its id: an insertion, a deletion and a replacement."""
    n = F.greatest(F.length(F.coalesce(text_col, F.lit(""))), F.lit(1))
    place = lambda salt: F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), n)
    edit = lambda at, delete, insert: F.struct(at.cast("long").alias("at"), F.lit(delete).cast("long").alias("delete"), F.lit(insert).alias("insert"))
    return F.array(edit(place(1), 0, " it's 12 new  words\n"), edit(place(2), 7, ""), edit(place(3), 3, "'re "))
