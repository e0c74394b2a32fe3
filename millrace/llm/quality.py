"""Quality rules as a short-circuit cascade.

``text_statistics`` computes the base counts of every text. ``estimate_rules`` times each
rule and counts its rejections on a bounded sample; ``cascade`` then applies the rules in
the order of rejections per second, each only to the texts that all earlier rules passed.
The order changes the work, never the verdict: a text is kept when no rule rejects it.

Defined results: a null text counts as empty (no words, so rejected by the word-count
rule); repeated rows are judged each by itself; a null id is carried through; an empty
table gives an empty result; further columns are left alone, and columns of the input
named like a result column are replaced.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import frugal
from millrace.llm.textblocks import TextBlock, blocks, windows

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Rows that ``estimate_rules`` reads at most, and bytes of each: longer texts are left out of the sample, so the driver takes in 64 MB at most.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 1 << 15


class Texts:
    """Counts of one block of texts, each computed when a rule first asks for it."""

    def __init__(self, block: TextBlock):
        self.block = block
        self._known: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name not in COUNTS:
            raise AttributeError(name)
        if name not in self._known:
            self._known[name] = getattr(self, f"_{name}")()
        return self._known[name]

    def _n_words(self):
        return self.block.n_words.astype(np.int64)

    def _word_chars(self):
        b = self.block
        return b.row_sums(b.inside & ((b.data & 0xC0) != 0x80))

    def _n_symbols(self):
        return self.block.row_sums(_IS_SYMBOL[self.block.data])

    def _n_dup_lines(self):
        b = self.block
        starts, ends, rows = b.lines()
        has_word = np.searchsorted(b.starts, ends) > np.searchsorted(b.starts, starts)
        starts, ends, rows = starts[has_word], ends[has_word], rows[has_word]
        again = _seen_earlier(rows, b.span_hashes(starts, ends))
        return np.bincount(rows[again], minlength=b.rows).astype(np.int64)

    def _n_repeat_words(self):
        b = self.block
        hashes, first = windows(b.word_hashes(), b.word_row, 3)
        repeated = _found_twice(b.word_row[first], hashes)
        covered = np.zeros(len(b.starts) + 3, bool)
        for k in range(3):
            covered[first[repeated] + k] = True
        return np.bincount(b.word_row[covered[: len(b.starts)]], minlength=b.rows).astype(np.int64)


def _runs(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (row, hash) together, earlier ones first, and where a value equals the one before."""
    order = np.lexsort((hashes, rows))
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = (rows[order][1:] == rows[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    return order, same


def _seen_earlier(rows, hashes):
    order, same = _runs(rows, hashes)
    out = np.zeros(len(order), bool)
    out[order] = same
    return out


def _found_twice(rows, hashes):
    order, same = _runs(rows, hashes)
    twice = same.copy()
    twice[:-1] |= same[1:]
    out = np.zeros(len(order), bool)
    out[order] = twice
    return out


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the counts of a block of texts to a boolean for each text."""

    name: str
    rejects: Callable[[Texts], np.ndarray]


def _per_word(part, n_words, most):
    return part > most * np.maximum(n_words, 1)


#: Rules on documents: words, repetition, symbols, repeated lines, word length.
DEFAULT_RULES = (
    Rule("too_few_words", lambda x: x.n_words < 50),
    Rule("repeated_words", lambda x: 100 * x.n_repeat_words > 50 * x.n_words),
    Rule("symbols", lambda x: _per_word(x.n_symbols, x.n_words, 0.3)),
    Rule("repeated_lines", lambda x: (x.n_dup_lines >= 4) & (2 * x.n_dup_lines > x.block.row_sums(x.block.data == 10) + 1)),
    Rule("word_length", lambda x: (x.word_chars > 40 * x.n_words) | (x.word_chars < 2 * x.n_words)),
)
BASE_RULES = ("too_few_words", "repeated_words")


@dataclass(frozen=True)
class RuleEstimate:
    name: str
    rejected: float
    seconds: float

    @property
    def rank(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate_rules(docs: DataFrame, text_col: str = "text", rules=DEFAULT_RULES, sample_rows: int = SAMPLE_ROWS) -> list[RuleEstimate]:
    """Each rule's share of rejections and seconds a text, on at most ``sample_rows`` rows, the highest rejection per second first."""
    # a hash of the text spreads the sample within the partitions; collect() reads a few of these after a few, until there are rows enough
    sample = [r.text for r in docs.select(F.col(text_col).alias("text")).where((F.pmod(F.xxhash64("text"), F.lit(16)) == 3) & (F.octet_length("text") <= SAMPLE_BYTES)).limit(sample_rows).collect()]
    spent, hits, n = dict.fromkeys([r.name for r in rules], 0.0), dict.fromkeys([r.name for r in rules], 0), max(1, len(sample))
    for block in blocks(pa.array(sample, pa.string())):
        for rule in rules:
            texts, began = Texts(block), time.perf_counter()  # fresh, so that shared counts are charged to each rule
            hits[rule.name] += int(np.count_nonzero(rule.rejects(texts)))
            spent[rule.name] += time.perf_counter() - began
    found = [RuleEstimate(r.name, hits[r.name] / n, spent[r.name] / n) for r in rules]
    return sorted(found, key=lambda e: -e.rank)


def _narrow(block: TextBlock, rows: np.ndarray) -> TextBlock:
    """The block of only some of the texts."""
    starts, ends = block.offsets[:-1][rows], block.offsets[1:][rows]
    keep = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    return TextBlock(block.data[np.cumsum(keep[:-1]).astype(bool)], np.concatenate([[0], np.cumsum(ends - starts)]), 0)


def _verdicts(block: TextBlock, ordered: list[Rule], texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The first rule of the cascade that rejects each text (-1: none), and how many rules looked at it."""
    alive, out, looked = np.arange(block.rows), np.full(block.rows, -1, np.int64), np.zeros(block.rows, np.int64)
    for k, rule in enumerate(ordered):
        if not len(alive):
            break
        looked[alive] += 1
        rejected = rule.rejects(texts)
        out[alive[rejected]] = k
        if rejected.any():
            alive = alive[~rejected]
            # drop the rejected texts' bytes when that saves much, else keep what is already counted
            if 2 * len(alive) < texts.block.rows:
                texts = Texts(_narrow(texts.block, np.flatnonzero(~rejected)))
            else:
                texts = _Masked(texts, np.flatnonzero(~rejected))
    return out, looked


class _Masked(Texts):
    """Some of the texts of another ``Texts``: counts made there are used, others are made there on demand."""

    def __init__(self, inner: Texts, rows: np.ndarray):
        self.inner, self.rows = inner, rows

    @functools.cached_property
    def block(self):
        return _narrow(self.inner.block, self.rows)

    def __getattr__(self, name):
        if name not in COUNTS:
            raise AttributeError(name)
        return getattr(self.inner, name)[self.rows]


def cascade(docs: DataFrame, text_col: str = "text", rules=DEFAULT_RULES, estimates: list[RuleEstimate] | None = None, with_counts: bool = True) -> DataFrame:
    """The input's columns with ``kept`` (no rule rejects the text), ``rules_run`` and ``rejected_by``; with ``with_counts``, also all base counts.

    Without counts only what the rules need until the first rejection is computed.
    """
    estimates = estimates if estimates is not None else estimate_rules(docs, text_col, rules)
    rank = {e.name: k for k, e in enumerate(estimates)}
    ordered = sorted(rules, key=lambda r: rank.get(r.name, len(rank)))
    names = [r.name for r in ordered]
    own = {*COUNTS, "kept", "rules_run", "rejected_by"} - {text_col}
    carried = [f for f in docs.schema.fields if f.name not in own]
    added = [*([T.StructField(c, T.LongType()) for c in COUNTS] if with_counts else []), T.StructField("kept", T.BooleanType()), T.StructField("rules_run", T.LongType()), T.StructField("rejected_by", T.StringType())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_col)):
                texts = Texts(block)
                # the counts are asked for before the cascade, which then finds them made
                counts = [pa.array(getattr(texts, c), pa.int64()) for c in COUNTS] if with_counts else []
                by, looked = _verdicts(block, ordered, texts)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(f.name).slice(block.first, block.rows) for f in carried], *counts, pa.array(by < 0), pa.array(looked), pa.array([names[k] if k >= 0 else None for k in by], pa.string())],
                    names=[f.name for f in [*carried, *added]],
                )

    return docs.select(*[F.col(f"`{f.name}`") for f in carried]).mapInArrow(frugal(judge), T.StructType([*carried, *added]))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """Per document: the base counts, ``base_failed`` (the two base rules) and ``kept`` (the whole cascade)."""
    judged = cascade(docs.select("doc_id", "text"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS, failed.alias("base_failed"), "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with all their columns unchanged."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text_to_judge"))
    return cascade(inner, "text_to_judge", with_counts=False).where("kept").select("row.*")
