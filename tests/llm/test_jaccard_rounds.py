"""The Jaccard join where buckets become families of differences, several levels deep, against comparing all sets."""

import random

import pytest

from millrace.llm import jaccard


def brute(texts, words, percent):
    sets = {}
    for i, text in texts:
        w = text.lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("small, near", [(2, 10), (1000, 10)])
def test_rounds_equal_brute_force(spark, monkeypatch, small, near):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "NEAR", near)
    dice = random.Random(7)
    base = [f"w{dice.randrange(60)}" for _ in range(150)]
    texts = []
    for i in range(90):  # copies of one text with none to seven edited words: some link, some only through others, many not at all
        words = list(base)
        for _ in range(i % 8):
            words[dice.randrange(len(words))] = f"w{dice.randrange(60)}"
        texts.append((i, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(spark.createDataFrame(texts, "doc_id long, text string"), words=3, percent=90).collect()}
    want = brute(texts, 3, 90)
    assert len({c for _, c in want.values()}) > 5
    assert got == want


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_crowds_without_their_base_equal_brute_force(spark, monkeypatch, words, percent):
    monkeypatch.setattr(jaccard, "SMALL", 4)
    monkeypatch.setattr(jaccard, "NEAR", 20)
    dice = random.Random(words)
    base, passage = [f"w{dice.randrange(500)}" for _ in range(300)], [f"p{k}" for k in range(40)]
    texts = []
    for i in range(120):  # edits of a text that is not there, in few places, so that differences are shared too
        own = list(base)
        for _ in range(1 + i % (9 if words == 3 else 16)):
            own[30 * dice.randrange(10) + dice.randrange(2)] = f"x{dice.randrange(4)}"
        texts.append((i, " ".join(own)))
    for i in range(60):  # one passage between texts of many sizes
        own = [f"o{dice.randrange(100_000)}" for _ in range(dice.randrange(8))]
        texts.append((1000 + i, " ".join(own[:3] + passage[: 40 - i % 5] + own[3:])))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similarity_classes(spark.createDataFrame(texts, "doc_id long, text string"), words=words, percent=percent).collect()}
    want = brute(texts, words, percent)
    assert 5 < len({c for _, c in want.values()}) < 175
    assert got == want
