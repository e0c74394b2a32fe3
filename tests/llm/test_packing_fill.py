"""How full sequences are, for pieces of one length and of many, and that equal runs give equal rows."""

import collections
import random

import public_tokenizers as public
import pytest
from pyspark.sql import functions as F

from millrace.llm.packing import EXACT, bar_of, pack, packed_documents, packing_patterns

MIXES = {
    "two": lambda rng: 2,
    "eight": lambda rng: 8,
    "hundreds": lambda rng: rng.randint(65, 127),
    "uneven": lambda rng: min(4096, max(1, int(rng.lognormvariate(5.5, 1.2)))),
}


@pytest.mark.parametrize("mix", MIXES)
def test_fill(spark, mix):
    rng = random.Random(1)
    lengths = [MIXES[mix](rng) for _ in range(5000)]
    pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "doc_id long, start long, length long")
    rows = pack(pieces, 4096).collect()
    assert collections.Counter(r.length for r in rows) == collections.Counter(lengths)
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and all(r.padded_length == (at if at & (at - 1) == 0 else 4096) for r in own)
        padded += own[0].padded_length
    assert sum(lengths) / padded > 0.95


@pytest.mark.parametrize("capacity", [1, 16, 50, 100, 4096])
def test_patterns_place_every_bar(capacity):
    rng = random.Random(capacity)
    for _ in range(5):
        histogram = collections.Counter(bar_of(rng.randint(1, capacity), capacity) for _ in range(rng.choice([1, 7, 900])))
        placed = collections.Counter()
        for pattern, times in packing_patterns(histogram, capacity):
            assert sum(s * n for s, n in pattern.items()) <= capacity and times > 0
            for s, n in pattern.items():
                placed[s] += n * times
        assert placed == histogram
    assert all(n <= bar_of(n, capacity) <= capacity for n in range(1, capacity + 1)) and bar_of(min(EXACT, capacity), capacity) == min(EXACT, capacity)
    assert packing_patterns({}, capacity) == []


def test_rows_that_tie_go_the_same_way_again(spark):
    texts = [(7, f"text number {k}") for k in range(60)] + [(7, "the same")] * 5 + [(None, "the same")] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one = packed_documents(docs.repartition(3), public.path("word_bpe_49k.json"))
    two = packed_documents(docs.orderBy(F.desc("text")).repartition(7), public.path("word_bpe_49k.json"))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, two.collect()), key=repr)
