"""Mixing sources: targets against plain fractions, cuts, repeats and odd rows."""

import collections
import fractions
import random

import pytest

from millrace.llm.mixing import mix_report, mix_sources, mixed_texts, source_targets
from millrace.llm.prefix_sums import prefix_sums

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes: dict[str | None, int], weights=(5, 2, 1), ceiling=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, out = fractions.Fraction(sum(sizes.values())), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > ceiling * sizes[s]}
        if not above:
            return out | share
        for s in above:
            out[s] = fractions.Fraction(ceiling * sizes[s])
            left -= out[s]
        open_ -= above
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{k}": rng.choice([0, 1, 5, 40, 1000, 10**6]) for k in range(rng.randint(1, 12))} | ({None: 17} if seed % 2 else {})
    rows = spark.createDataFrame([(s is None, s or "", n) for s, n in sizes.items()], "no_source boolean, name string, source_size long")
    expected = plain_targets(sizes)
    got = {None if r.no_source else r.name: r for r in source_targets(rows).collect()}
    assert set(got) == set(expected)
    for s, e in expected.items():
        assert got[s].target == pytest.approx(float(e), rel=1e-12) and abs(got[s].budget - e) <= fractions.Fraction(1, 2)


def odd_rows():
    rng = random.Random(3)
    rows = [(k, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "", "zz", None])) for k in range(80)]
    return [*rows, (None, "x y z", "a"), (None, None, None), (7, "x " * 20_000, "b"), (5, "one two", "a"), (5, "one two", "a"), (90, None, "empty"), (91, " \t\n", "empty")]


def test_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as size", "'t' as target", "2 as taken", "3 as `group`", "4 as before", "5 as id", "6 as name", "7 as row")
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").split())
    expected = plain_targets(sizes)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == sizes[r.source] and (r.before, r.id, r.name, r.row) == (4, 5, 6, 7)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - e) <= fractions.Fraction(1, 2) for s, e in expected.items())
    again = mix_report(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert sorted(again, key=repr) == sorted(mix_report(docs).collect(), key=repr)
    told = collections.Counter()
    for r in mixed_texts(docs).collect():
        assert len(r.text.split()) == r.words_taken <= r["size"]
        told[r.source] += r.words_taken
    assert {s: n for s, n in told.items() if n} == {s: n for s, n in taken.items() if n}
    assert mix_report(docs.limit(0)).count() == 0


def test_prefix_sums_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randint(0, 10**6), k, rng.randint(0, 9)) for k in range(3000)]
    table = spark.createDataFrame(rows, "g string, o long, k long, v long")
    before = {r.k: r.s for r in prefix_sums(table, "g", ["o", "k"], {"v": "s"}, partitions=40).collect()}
    total = collections.Counter()
    for g, _, k, v in sorted(rows):
        assert before[k] == total[g]
        total[g] += v
