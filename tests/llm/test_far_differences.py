"""Sets that share a bucket with a pivot and little else leave before all their differences become rows."""

import random

from millrace.llm import jaccard


def test_far_sets_leave_early(spark, monkeypatch):
    rng = random.Random(9)
    token = lambda: rng.getrandbits(62)
    order = lambda tokens: sorted(t for t in tokens if t >= 0) + sorted((t for t in tokens if t < 0), reverse=True)  # noqa: E731  as _differences has it
    common = [token() for _ in range(8)]
    far = [[*rng.sample(common, 4), *(token() for _ in range(71)), *(~token() for _ in range(75))] for _ in range(200)]
    near = []
    for _ in range(20):  # pairs that share 146 of 150 differences
        base = [*(token() for _ in range(71)), *(~token() for _ in range(75))]
        near += [[*base, *(token() for _ in range(4))] for _ in range(2)]
    small = [[token()] for _ in range(3)]
    small += [small[0], small[1]]  # each needs one difference only
    rows = [(0, 0, 1 + k, 1 + k, 100, len(d), order(d), False) for k, d in enumerate([*far, *near])]
    rows += [(0, 0, 1000 + k, 1000 + k, 100, 1, d, False) for k, d in enumerate(small)]
    found = spark.createDataFrame(rows, "family long, pivot long, id long, c long, n long, d long, diff array<long>, linked boolean")
    seen = []
    monkeypatch.setattr(jaccard, "_unique", lambda tokens, _unique=jaccard._unique: (seen.append(tokens.count()), _unique(tokens))[1])
    index = jaccard._near(found, 90)
    pairs = {(r.a, r.b) for r in jaccard._near_pairs(index, 90).collect()}
    assert pairs == {(201 + 2 * k, 202 + 2 * k) for k in range(20)} | {(1000, 1003), (1001, 1004)}
    assert seen == [240 * (150 - 139 + 16) + 5, 40 * 150 + 4]  # of 36,005 differences
