"""Vectors whose squares leave the range of a double."""

import numpy as np

from millrace.llm.cover_tree import near_vectors


def test_very_large_and_small_components(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 6))
    rows = []
    for k, v in enumerate(base):
        for j, factor in enumerate((1.0, 1e200, 1e-200, 1e307, 1e-307)):
            rows.append((10 * k + j, ((v + 0.01 * j) * factor).tolist()))
    rows += [(100, [0.0, -0.0]), (101, [float("inf"), 1.0]), (102, [float("nan"), 1.0]), (103, [None, 1.0]), (104, [-5e-324, 0.0]), (105, [-1.7e308, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), cosine=0.98).collect()}
    unit = np.array([v + 0.01 * j for v in base for j in range(5)])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.98
    for at, (k, _) in enumerate(rows[:15]):
        assert got[k] == (near[at].sum() - 1, k // 10 * 10) and near[at].sum() == 5
    assert [got[k] for k in range(100, 106)] == [(0, 100), (0, 101), (0, 102), (0, 103), (1, 104), (1, 104)]
