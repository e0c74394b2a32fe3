"""Comparison of a Spark result with DuckDB's, whatever the order of rows and columns."""

from __future__ import annotations

import math

import pandas as pd


def _plain(x):
    if x is None or x is pd.NaT or x is pd.NA:
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    return x


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False, name=None)), key=repr)


def same(spark_df, duck, sql: str) -> None:
    ours, theirs = spark_df.toPandas(), duck.execute(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not different, f"{len(different)} of {len(a)} rows differ: {different[:3]}"
