"""The table of prefixes by hash, many chunks at a time, and the choice of chunks that may differ from their best."""

import heapq
import math
import random

import numpy as np
import public_tokenizers as public

from millrace.llm.piece_nbest import _SEED, SPACE, PieceLattice, _least
from millrace.llm.textblocks import mix

MODEL = public.path("piece_bpe_32k.model")


def test_slots_hold_all_prefixes():
    own = PieceLattice(MODEL)
    assert np.count_nonzero(own.keys) == len(own.prefixes) and len(own.keys) >= 4 * len(own.prefixes)
    own.slots = np.uint64(63)  # as if all keys crowded
    own.keys = np.zeros(64 + 41, np.uint64)
    hashes = mix(np.arange(1, 41).astype(np.uint64) * _SEED)
    for h in hashes.tolist():
        place = h & 63
        while own.keys[place]:
            place += 1
        own.keys[place] = h
    assert (own.keys[own._slots(hashes)] == hashes).all()
    others = mix(np.arange(100, 200).astype(np.uint64) * _SEED)
    assert (own.keys[own._slots(others)] != others).all()


def test_many_chunks_equal_single_ones():
    own, rng = PieceLattice(MODEL), random.Random(7)
    chunks = [SPACE + "".join(rng.choices("aeinrstlodu#一é\U0001f600", k=rng.randint(1, 12))) for _ in range(300)] + [SPACE, "一"]
    for chunk, (ids, score, loss) in zip(chunks, own.best_of_many(chunks), strict=True):
        ways = own.n_best(chunk, 2)
        assert score == ways[0][0] and sum(own.usual_score(i) is None for i in np.frombuffer(ids, "<u4").tolist()) == sum(own.usual_score(i) is None for i in ways[0][1])
        assert loss == (ways[0][0] - ways[1][0] if len(ways) > 1 else math.inf)


def test_least_losses():
    rng = random.Random(8)
    for size in (0, 1, 2, 3, 50):
        for n in (0, 1, 3, 50):
            losses = tuple(rng.choice((0.0, 0.5, 1.0, 2.0, math.inf)) for _ in range(size))
            assert _least(losses, n) == sorted(k for _, k in heapq.nsmallest(n, [(x, k) for k, x in enumerate(losses) if x < math.inf]))
