"""Tables written on the way are gone when a stage has ended, and parts of Bloom filters are as small as what they hold."""

import os
import random

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import jaccard
from millrace.llm.shared import shared_dir
from millrace.llm.twice_filter import CHUNK_BITS, TwicePair, _unpacked, build_twice_filter, suspected


def folders(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage, out = [word() for _ in range(40)], []
    for _ in range(40):
        base = [word() for _ in range(120)]
        for _ in range(rng.randrange(1, 5)):  # near copies, and one passage in most of them
            changed = list(base)
            changed[rng.randrange(120)] = word()
            out.append(changed + passage * (rng.random() < 0.7))
    return [(k, " ".join(x)) for k, x in enumerate(out)]


@pytest.mark.parametrize("limit", [2, None])
@pytest.mark.parametrize("stage, stay", [(corpus_pipeline.near_duplicates, {"set-facts", "links", "many-texts"}), (corpus_pipeline.substring_dedup, {"spans"})])
def test_only_what_the_result_reads_is_left(spark, monkeypatch, stage, stay, limit):
    if limit:  # buckets are large from here on, so there are families and levels of them
        monkeypatch.setattr(jaccard, "SMALL", limit)
        monkeypatch.setattr(jaccard, "NEAR", limit)
    before = folders(spark)
    out = stage(spark, spark.createDataFrame(texts(), "doc_id long, text string"), "").collect()
    assert out
    assert {f.rsplit("-", 1)[0] for f in folders(spark) - before} <= stay


def test_parts_of_filters_are_small():
    rng = np.random.default_rng(4)
    pair = TwicePair(1 << 24)
    pair.add(rng.integers(0, 1 << 64, 10_000, np.uint64))
    parts = list(pair.chunks())
    size = CHUNK_BITS // 8
    assert sum(len(once) for _, once, _ in parts) <= 1.6 * np.count_nonzero(pair.once)
    for k, once, twice in parts:
        assert np.array_equal(_unpacked(once, size), pair.once[k * size : (k + 1) * size])
        assert np.array_equal(_unpacked(twice, size), pair.twice[k * size : (k + 1) * size])


def test_dense_filters_of_many_parts(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(63) for _ in range(3000)]
    rows = spark.createDataFrame([(v,) for v in values + values[:1000]], "v long").repartition(7)
    twice = build_twice_filter(rows, lambda batch: [batch.column("v").to_numpy().view(np.uint64)], 1 << 16)
    found = suspected(twice, np.array(values, np.uint64))
    assert found[:1000].all() and found[1000:].sum() < 40
