"""Trees whose coarse levels join few vectors are descended from a lower level, so their wide nodes don't pair with nearly all others."""

import numpy as np

from millrace.llm import cover_tree


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def met(monkeypatch, x, y):
    """Node pairs decided one by one, after holding the links against brute force."""
    decided = []
    monkeypatch.setattr(cover_tree, "_decide", lambda *a, _decide=cover_tree._decide: (decided.append(len(a[2])), _decide(*a))[1])
    paths = [cover_tree.cover_paths(v).astype(np.int64) for v in (x, y)]
    a, b, i, j = cover_tree.dual_traversal(x, np.ones(len(x)), paths[0], y, np.ones(len(y)), paths[1], 0.9)
    near = x @ y.T >= 0.9
    assert (a == near.sum(1)).all() and (b == near.sum(0)).all() and near[i, j].all()
    assert set(i) == set(np.flatnonzero(near.any(1))) and set(j) == set(np.flatnonzero(near.any(0)))
    return sum(decided), int(near.sum()), cover_tree._first_level(*paths)


def test_far_vectors_with_some_copies(monkeypatch):
    rng = np.random.default_rng(4)
    base = unit(rng.normal(size=(900, 64)))
    copies = unit(base[:100] + rng.normal(size=(100, 64)) * rng.uniform(0, 0.1, size=(100, 1)))
    loose = unit(base[100:200] + 0.7 * unit(rng.normal(size=(100, 64))))
    x, y = np.concatenate([base[::2], copies, loose]), np.concatenate([base[1::2], copies[::-1], loose])
    decided, near, start = met(monkeypatch, x, y)
    assert near > 200 and start > 0
    assert decided < 4 * near  # 650 * 650 pairs of vectors


def test_crowds_start_near_the_top(monkeypatch):
    rng = np.random.default_rng(5)
    base = unit(rng.normal(size=(12, 64)))
    x, y = (unit(np.repeat(base, 50, 0) + rng.normal(size=(600, 64)) * 0.03) for _ in range(2))
    decided, near, start = met(monkeypatch, x, y)
    assert start <= 1 and near > 20_000 and decided < 200_000
