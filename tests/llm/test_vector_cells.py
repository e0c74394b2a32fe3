"""Pairs of cells of vectors meet without a shuffle of copies, whatever their number."""

import numpy as np

from millrace.llm import cover_tree


def test_pairs_of_cells_are_not_shuffled(spark, monkeypatch):
    plans = {}

    def stash(df, name, _stash=cover_tree.stash):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return _stash(df, name)

    monkeypatch.setattr(cover_tree, "CELL_ROWS", 50)
    monkeypatch.setattr(cover_tree, "stash", stash)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 32)).astype(np.float32)
    x[300:] = x[:100] + rng.normal(size=(100, 32)) * rng.uniform(0, 0.6, size=(100, 1))
    x[399] = 4 * x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in cover_tree.near_vectors(df).collect()}
    assert "CartesianProduct" in plans["near"] and "Exchange" not in plans["near"]
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    assert got == {k: int(near[k].sum()) - 1 for k in range(400)} and near.sum() > 450
