"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm.chat import chat_digests
from millrace.llm.cover_tree import near_vectors
from millrace.llm.divergence import source_divergence
from millrace.llm.jaccard import jaccard_classes
from millrace.llm.line_dedup import line_digests
from millrace.llm.mixing import mix_report
from millrace.llm.packing import packed_documents
from millrace.llm.periodic_runs import run_digests
from millrace.llm.piece_nbest import n_best_digests
from millrace.llm.quality import quality_verdicts
from millrace.llm.substring_dedup import passage_digests
from millrace.llm.token_trees import edited_counts, sample_edits
from millrace.llm.warc import archived_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(_table(spark, sf_dir, "pages"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(_table(spark, sf_dir, "conversations"))


def op3_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited_counts(docs.withColumn("edits", sample_edits()), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digests(_table(spark, sf_dir, "documents"))


def op7_piece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n_best_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(_table(spark, sf_dir, "documents"))


def op10_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(_table(spark, sf_dir, "documents"))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(_table(spark, sf_dir, "documents"))


_ALL = (
    *(op1_warc_segments, op2_chat_format, op3_edit_token_counts, op4_line_dedup, op5_packing, op6_substring_dedup, op7_piece_nbest),
    *(op8_embedding_pairs, op9_jaccard_join, op10_quality_cascade, op11_source_mix, op12_source_divergence, op13_periodic_runs),
)
QUERIES = {f.__name__: f for f in _ALL}
