"""Runs against all lags in plain Python, and the texts that stay."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from millrace.llm.periodic_runs import block_runs, find_runs, run_digests
from millrace.llm.textblocks import blocks


def plain_runs(words, min_length=6, min_exponent=4):
    found = []
    for q in range(1, len(words) // min_exponent + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            n = end - at + q
            if end > at and n >= max(min_length, min_exponent * q) and not any(s <= at and at + n <= s + m for s, m, _ in found):
                found.append((at, n, q))
            at = max(end, at + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def random_words(rng):
    words = [rng.randint(0, rng.choice([0, 1, 2, 50])) for _ in range(rng.randint(0, 500))]
    for _ in range(rng.randint(0, 4)):
        if len(words) > 5:
            a = rng.randrange(len(words))
            p, m = 1 + rng.randrange(max(1, (len(words) - a) // 3)), rng.randint(0, len(words) - a)
            for i in range(a + p, a + m):
                words[i] = words[i - p]
    if rng.random() < 0.3:  # periods that hold shorter periods
        words = ([1] * rng.randint(4, 9) + [2]) * rng.randint(3, 7)
        words[rng.randrange(len(words))] = 9
        words *= rng.randint(1, 6)
    return [f"w{x}" for x in words]


@pytest.mark.parametrize("seed", range(6))
def test_blocks_against_all_lags(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        rows, runs = block_runs(next(blocks(pa.array([" ".join(t) for t in texts]))), 6, 4)
        got = [[] for _ in texts]
        for row, run in zip(rows, runs.tolist(), strict=True):
            got[row].append(tuple(run))
        assert got == [plain_runs(t) for t in texts]


def test_other_limits():
    rng = random.Random(9)
    for _ in range(60):
        words = random_words(rng)
        _, runs = block_runs(next(blocks(pa.array([" ".join(words)]))), 9, 3)
        assert [tuple(r) for r in runs.tolist()] == plain_runs(words, 9, 3)
    with pytest.raises(ValueError, match="three periods"):
        block_runs(next(blocks(pa.array(["a a a a a a a a a"]))), 6, 2)


def test_digests_and_odd_rows(spark):
    rng = random.Random(4)
    texts = [(k, " ".join(random_words(rng))) for k in range(120)]
    texts += [(None, "a a a a a a a b"), (None, None), (200, None), (201, ""), (202, " \t\x0b "), (203, "a " * 40_000), (204, "x\ny\r\nx y\tx y x y"), (204, "x\ny\r\nx y\tx y x y"), (205, "ä ö " * 9 + "z" * 100_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as runs", "2 as collapsed", "3 as start", "4 as n_runs")
    expected = []
    for doc_id, text in texts:
        words = (text or "").encode().split()
        words = plain_planted(doc_id, words) if doc_id is not None else words
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        expected.append((doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, told, kept))
    assert sorted(map(tuple, run_digests(docs).collect()), key=repr) == sorted(expected, key=repr)
    assert run_digests(docs.limit(0)).count() == 0
    found = {r.doc_id: r for r in find_runs(docs).where("doc_id >= 200").collect()}
    assert found[200].collapsed is None and found[200].runs == [] and found[203].collapsed == "a" and found[204].collapsed == "x y" and found[204].start == 3
