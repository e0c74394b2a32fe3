"""Divergence of sources against plain Python over whole numbers, in tiles of several shapes."""

import collections
import random
import re

import numpy as np
import pytest

from millrace.llm.divergence import shares, source_divergence

SCHEMA = "lang string, source string, text string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs, ranks=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, held, groups = collections.Counter(), collections.Counter(), set()
    for lang, source, text in rows:
        g = (lang or "", source or "")
        groups.add(g)
        terms = TERM.findall((text or "").translate(lower))
        for t in terms:
            counts[*g, t] += 1
        for t in set(terms):
            held[g[0], t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in held.items() if x == lang and n >= min_docs]
        own = sorted(s for x, s in groups if x == lang)
        n = {s: {t: counts[lang, s, t] for t in kept} for s in own}
        whole = {t: sum(n[s][t] for s in own) for t in kept}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: p_of(n[s]) for s in own}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if n[s][t] > 0 and p[s][t] > q[t])[:ranks]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(terms)]
    return sorted(out)


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "über", "ÜBER", "naïve", "x", "日本", "don", "t", "été", *[f"w{chr(97 + k)}" for k in range(16)]]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "d", "é", None, "only"]), " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) + rng.choice(["", "!", "1a2", "\x00b"])) for _ in range(160)]
    return [*rows, ("fr", "a", "rare words"), ("fr", "b", None), ("lone", "a", "the the"), (None, None, None), ("en", "hot", "the " * 5000), ("en", "empty", ""), *[("en", "copies", "one text again")] * 12]


@pytest.mark.parametrize("shape", [(4096, 128), (7, 2), (1, 1)])
def test_against_plain_python(spark, shape):
    rows = rows_of(shape[0])
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as item", "2 as value", "3 as rank", "4 as block", "5 as n")
    got = source_divergence(docs, 10, 10, *shape)
    assert got.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 10)
    assert source_divergence(docs.limit(0)).count() == 0


def test_shares_of_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        v, total = rng.randint(1, 10**9), rng.randint(0, 9 * 10**15 - 2 * 10**9)
        count = rng.randint(0, total)
        assert shares(np.array([count]), np.array([total]), v)[0] == 1 + 10**9 * (count + 2) // (total + 2 * v)
    assert shares(np.array([5]), np.array([5]), 1)[0] == 1 + 10**9
