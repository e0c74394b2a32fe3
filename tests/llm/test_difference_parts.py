"""Only the first differences of a set become rows of the tables by which pairs are found, however many it shares with others of its family."""

import random

from pyspark.sql import functions as F

from millrace.llm import jaccard


def order(tokens):
    return sorted(t for t in tokens if t >= 0) + sorted((t for t in tokens if t < 0), reverse=True)  # as _differences has it


def near(spark, monkeypatch, rows, percent):
    """Pairs to compare, and how many shared differences were ranked."""
    ranked = []

    def stash(df, name, _stash=jaccard.stash):
        out = _stash(df, name)
        if name == "near-counts":
            ranked.append(out.agg(F.sum("df")).first()[0])
        return out

    monkeypatch.setattr(jaccard, "stash", stash)
    found = spark.createDataFrame(rows, "family long, pivot long, id long, c long, n long, d long, diff array<long>, linked boolean")
    pairs = {(r.a, r.b) for r in jaccard._near_pairs(jaccard._near(found, percent), percent).collect()}
    return pairs, ranked[0]


def test_rows_grow_with_misses_and_not_with_differences(spark, monkeypatch):
    dice = random.Random(5)
    token = lambda: dice.getrandbits(62)
    rows = []
    for k in range(30):  # pairs far from the pivot that share 146 of 150 differences
        base = [*(token() for _ in range(71)), *(~token() for _ in range(75))]
        for side in range(2):
            rows.append((0, 0, 1 + 2 * k + side, 1 + 2 * k + side, 100, 150, order([*base, *(token() for _ in range(4))]), False))
    pairs, ranked = near(spark, monkeypatch, rows, 90)
    assert pairs == {(1 + 2 * k, 2 + 2 * k) for k in range(30)}
    assert ranked <= 60 * (150 - 139 + 16)  # of 60 * 146


def test_similar_sets_of_all_sizes_are_compared(spark, monkeypatch):
    dice = random.Random(6)
    token = lambda: dice.getrandbits(62)
    for percent in (80, 90):
        pivot = {token() for _ in range(120)}
        sets = []
        for size in (90, 110, 130, 150):
            for _ in range(6):  # what they share with each other, and not with the pivot, is little or nearly all
                base = [*dice.sample(sorted(pivot), dice.randrange(size // 4, min(size, 120))), *(token() for _ in range(size))][:size]
                for _ in range(5):
                    drop, add = dice.randrange(7), dice.randrange(7)
                    sets.append(frozenset([*dice.sample(base, size - drop), *(token() for _ in range(add))]))
        similar = lambda x, y: 100 * len(x & y) >= percent * len(x | y)
        rows, want = [], set()
        for i, x in enumerate(sets, 1):
            diff, linked = [*(x - pivot), *(~t for t in pivot - x)], similar(x, pivot)
            rows.append((0, 0, i, 0 if linked else i, len(x), len(diff), order(diff), linked))
        for i, x in enumerate(sets, 1):
            want |= {(i, j) for j, y in enumerate(sets[i:], i + 1) if similar(x, y) and rows[i - 1][3] != rows[j - 1][3]}
        with monkeypatch.context() as patch:
            pairs, _ = near(spark, patch, rows, percent)
        assert len(want) > 40 and want <= pairs
        assert len(pairs) < len(sets) * len(sets) / 8
