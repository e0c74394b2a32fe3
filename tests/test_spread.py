"""Operators whose hot groups spread over tasks, against plain forms on odd rows."""

import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.extensions import mergeable_aggregate
from millrace.operators import quantiles
from millrace.operators.joins import asof_join_spread
from millrace.operators.quantiles import exact_quantiles, numeric_histograms
from millrace.operators.windows import range_frame


def test_asof_of_a_hot_key(spark):
    rng = random.Random(2)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(k, key(), rng.choice([None, *range(400)])) for k in range(1500)]
    right = [(k, key(), rng.choice([None, *range(0, 400, 3)]), f"v{k}" if k % 5 else None) for k in range(300)]
    ldf, rdf = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "rid long, k2 string, rt long, v string").withColumnRenamed("k2", "k")
    got = {r.id: (r.rid, r.v) for r in asof_join_spread(ldf, rdf, "k", "t", "rt", ["rid", "v"], "rid", partitions=13).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        before = [(rt, rid, v) for rid, rk, rt, v in right if k is not None and rk == k and t is not None and rt is not None and rt <= t]
        expected = max(before)[1:] if before else (None, None)
        assert got[i] == expected
    assert asof_join_spread(ldf.limit(0), rdf, "k", "t", "rt", ["rid"], "rid").count() == 0
    assert asof_join_spread(ldf, rdf.limit(0), "k", "t", "rt", ["rid"], "rid").where("rid is null").count() == len(left)


def test_asof_spreads_a_hot_key(spark):
    """The key of all rows reaches as many partitions as were asked for."""
    left, right = spark.range(4000).selectExpr("id", "'x' as k", "id as t"), spark.range(1000).selectExpr("id as rid", "'x' as k", "id * 4 as rt")
    joined = asof_join_spread(left, right, "k", "t", "rt", ["rid"], "rid", partitions=8)
    assert joined.where("rid = t div 4").count() == 4000
    path = next(iter(joined.inputFiles())).rsplit("/", 1)[0]
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy("_p").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 5000 / 8


def test_range_frames(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["x", "x", "x", "y", None]), rng.choice([None, *[rng.randint(-300, 300) for _ in range(9)]]), rng.choice([None, 1.0, 2.5])) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, g string, o long, v double")
    for below, above in ((7, 2), (0, 0), (0, 25)):
        got = {r.id: (r.n, r.s) for r in range_frame(df, ["g"], "o", below, above, {"v": "s"}, "n").collect()}
        assert len(got) == len(rows)
        for i, g, o, _ in rows:
            near = [v for _, g2, o2, v in rows if g2 == g and (o2 is None if o is None else o2 is not None and o - below <= o2 <= o + above)]
            known = [v for v in near if v is not None]
            assert got[i] == (len(near), sum(known) if known else None)


@pytest.mark.parametrize("bins", [2, 1024])
def test_exact_quantiles(spark, monkeypatch, bins):
    monkeypatch.setattr(quantiles, "BINS", bins)
    rng = random.Random(4)
    kinds = {"flat": lambda: rng.uniform(-5, 5), "ties": lambda: rng.choice([1.0, 2.0]), "one": lambda: 7.0, "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.randint(-30, 30), "ends": lambda: rng.choice([-1.7e308, 0.0, 1.7e308, 5e-324])}
    rows = [(g, f()) for g, f in kinds.items() for _ in range(301)] + [(None, 4.0), (None, 5.0), ("nulls", None), ("flat", None), ("single", 3.0)]
    fractions = {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", fractions).collect()}
    assert set(got) == {*kinds, None, "nulls", "single"}
    for g, r in got.items():
        values = sorted(v for x, v in rows if x == g and v is not None)
        if not values:
            assert r.low is r.mid is None
            continue
        assert (r.low, r.high) == (values[0], values[-1])
        if g != "ends":
            assert r.mid == pytest.approx(statistics.median(values), rel=1e-12) and r.q == pytest.approx(float(np.quantile(values, 0.37)), rel=1e-9)
    empty = spark.createDataFrame([], "g string, v double")
    assert exact_quantiles(empty, ["g"], "v", fractions).count() == 0
    assert exact_quantiles(spark.createDataFrame([(1.0,), (2.0,)], "v double"), [], "v", {"m": 0.5}).first().m == 1.5
    with pytest.raises(ValueError, match="between 0 and 1"):
        exact_quantiles(empty, ["g"], "v", {"x": 1.5})
    with pytest.raises(Exception, match="not finite"):
        exact_quantiles(spark.createDataFrame([("a", float("nan"))], "g string, v double"), ["g"], "v", fractions).collect()


def test_histograms_hold_all_rows(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("g"), F.sqrt("id").alias("v"))
    heights = numeric_histograms(df, "g", "v", 25).groupBy("g").agg(F.sum("height").alias("n"), F.count("*").alias("bins")).collect()
    assert [(round(r.n), r.bins) for r in heights] == [(2500, 25)] * 2


def test_mergeable_aggregate(spark):
    def update(batch: pd.DataFrame) -> pd.DataFrame:
        state = pd.DataFrame({"k": batch.k, "n": 1, "low": batch.v, "seen": 2 ** (batch.v % 8)})
        return state.groupby("k", as_index=False).agg({"n": "sum", "low": "min", "seen": lambda s: int(np.bitwise_or.reduce(s))})

    df = spark.range(3000, numPartitions=7).selectExpr("id % 3 as k", "id as v")
    fields = {"n": ("long", "sum"), "low": ("long", "min"), "seen": ("long", "bits")}
    got = mergeable_aggregate(df, "k", ["v"], fields, update, {"n": F.col("n"), "low": F.col("low"), "kinds": F.bit_count("seen")})
    assert sorted(map(tuple, got.collect())) == [(0, 1000, 0, 8), (1, 1000, 1, 8), (2, 1000, 2, 8)]
    assert mergeable_aggregate(df.limit(0), "k", ["v"], fields, update, {"n": F.col("n")}).count() == 0
    with pytest.raises(ValueError, match="no merge"):
        mergeable_aggregate(df, "k", ["v"], {"n": ("long", "mean")}, update, {})
