"""A corpus pipeline in five stages: quality rules, line dedup, n-gram Jaccard join, substring dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.jaccard import keep_one_of_each
from millrace.llm.line_dedup import drop_shared_lines
from millrace.llm.packing import packed_documents
from millrace.llm.quality import keep_good
from millrace.llm.shared import stash
from millrace.llm.substring_dedup import drop_repeated_passages


def _as_documents(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the character count of the new text."""
    own = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`")
    return changed.select(*[own(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. A null or empty text has no words and goes; repeated rows are judged each by itself; other columns stay as they are."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share. A null text stays null; a text of shared lines only becomes empty; rows that share an id count as documents of their own."""
    return _as_documents(drop_shared_lines(docs), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    The one of the least id stays, with all rows of that id. Null, empty and wordless texts are near nothing and stay, as do rows with a null id.
    """
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that one of a smaller id holds. A null text stays null; rows that share an id don't remove from each other; a null id counts as the smallest."""
    return _as_documents(drop_repeated_passages(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 4096. A null or empty text is its end id alone; repeated rows are packed each by itself."""
    return packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Tokens and similarity classes of whole shingle sets are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
