"""The pipeline on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm.shared import new_path


def _documents(spark):
    dice = random.Random(9)
    text = lambda n: " ".join(f"word{dice.randrange(3000)}" for _ in range(n))
    whole, line = text(200), "A line that is long enough to count as one of the shared lines."
    passage = text(80)
    rows = [(1, whole), (1, whole), (2, whole), (3, whole + " end"), (4, None), (5, ""), (6, "few words"), (None, text(90)), (None, None), (7, text(60_000)), (8, "x" * 300_000 + " " + text(60))]
    rows += [(20 + k, f"{text(70)}\n{line}") for k in range(6)] + [(40 + k, f"{text(60)} {passage} {text(60)}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(("id", "row", "tag", "n_words", "n_lines", "kept", "component_id", "sequence_id"))])


def test_stages_on_odd_rows(spark):
    docs, seen = _documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(path := new_path(spark, "odd"))
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
        seen[name] = out.collect()
    ids = {name: sorted((r.doc_id for r in rows), key=repr) for name, rows in seen.items()}
    # 4, 5, 6 and the null text have too few words, 8 too long ones
    assert ids["quality_rules"] == sorted([1, 1, 2, 3, None, 7, *range(20, 26), 40, 41, 42], key=repr)
    assert sorted(r.text.count("A line that") for r in seen["line_dedup"] if r.doc_id and 20 <= r.doc_id < 26) == [0] * 5 + [1]
    assert ids["near_duplicates"] == sorted([1, 1, None, 7, *range(20, 26), 40, 41, 42], key=repr)
    assert all(r.n_chars == len(r.text) for r in seen["substring_dedup"])
    words = {r.doc_id: len(r.text.split()) for r in seen["substring_dedup"]}
    assert (words[40], words[41], words[42]) == (200, 120, 120)
    assert {r.doc_id for r in seen["packing"]} == set(ids["near_duplicates"]) and sum(r.doc_id == 7 for r in seen["packing"]) > 10


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    docs = _documents(spark)
    for name, rows in (("odd", docs), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert (out.count() > 0) == (name == "odd")
        assert out.columns[:2] == ["doc_id", "start"]
