"""Passages between very many different neighbours, by the index and by windows, against plain Python."""

import hashlib
import random

import pytest

from millrace.llm import substring_dedup
from millrace.llm.substring_dedup import passage_digests


def plain(texts, size=13):
    first = {}
    for doc_id, text in texts:
        words = text.split()
        for i in range(len(words) - size + 1):
            w = tuple(words[i : i + size])
            first[w] = min(first.get(w, doc_id), doc_id)
    out = []
    for doc_id, text in texts:
        words = text.split()
        gone = {i + j for i in range(len(words) - size + 1) if first[tuple(words[i : i + size])] < doc_id for j in range(size)}
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc_id, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [2, 3000])
def test_one_passage_in_many_texts(spark, monkeypatch, crowd):
    monkeypatch.setattr(substring_dedup, "CROWD", crowd)
    rng = random.Random(crowd)
    passages = [" ".join(f"p{rng.randint(0, 400)}" for _ in range(n)) for n in (12, 13, 14, 20, 90)]
    own = lambda: " ".join(f"o{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 9)))
    texts = [(k, " ".join(x for _ in range(rng.randint(0, 3)) for x in (own(), rng.choice(passages)))) for k in range(80)]
    texts += [(k, "again " * rng.randint(0, 40)) for k in range(80, 90)]
    assert sorted(map(tuple, passage_digests(spark.createDataFrame(texts, "doc_id long, text string")).collect())) == plain(texts)
