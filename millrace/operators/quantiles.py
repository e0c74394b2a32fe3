"""Exact quantiles without holding a group, and adaptive histograms.

A quantile is one or two order statistics. Each is searched for by histograms: all values of its range are counted in
equal bins (added up before the shuffle), the bin that holds the rank becomes the next range, between the least and the
greatest value in it. A range of one value is the answer. A round reads the rows once and shuffles at most ``BINS`` counts for
each group and rank; a handful of rounds is enough unless values are spaced by powers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.scratch import scratch_path
from millrace.sources import table

BINS = 1024
#: Rows of the table of ranges that are broadcast; with more, rows meet their ranges in a shuffle.
BROADCAST_RANGES = 100_000


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """For each group of ``keys``, the quantiles ``fractions`` (name to fraction) of ``value``, linear between neighbours; null values don't count.

    A group without values gets nulls. Infinite and NaN values are refused.
    """
    if not all(0 <= p <= 1 for p in fractions.values()):
        raise ValueError("a fraction lies between 0 and 1")
    own = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col(value).cast("double").alias("_v"))
    strange = F.isnan("_v") | F.col("_v").isin(float("inf"), float("-inf"))
    rows = rows.withColumn("_v", F.when(strange, F.raise_error(F.lit(f"{value} has a value that is not finite"))).otherwise(F.col("_v")))
    groups = _written(rows.groupBy(*own).agg(F.count("_v").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")), "quantile-groups")
    # a rank for the value below and one for the value above each quantile
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    wanted = F.explode(F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in fractions.values()]))))
    ranges = groups.where("_n > 0").select(*own, wanted.alias("_rank"), F.lit(0).cast("long").alias("_below"), "_low", "_high")
    ranges = _written(ranges, "quantile-ranges")
    values = rows.where("_v is not null")
    while (open_ranges := ranges.where("_low < _high")).count():
        ranges = _written(ranges.where("_low = _high").unionByName(_narrowed(values, open_ranges, own)), "quantile-ranges")
    found = ranges.groupBy(*own).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_low"))).alias("_found"))
    joined = groups.join(found, _same(groups, found, own), "left").select(*[groups[o] for o in own], "_n", "_found")

    def between(p: float) -> Column:
        low, high = F.try_element_at("_found", F.floor(place(p))), F.try_element_at("_found", F.ceil(place(p)))
        return F.when(F.col("_n") > 0, low + (high - low) * (place(p) - F.floor(place(p))))

    return joined.select(*[F.col(o).alias(k) for k, o in zip(keys, own, strict=True)], *[between(p).alias(name) for name, p in fractions.items()])


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def _narrowed(values: DataFrame, ranges: DataFrame, own: list[str]) -> DataFrame:
    """Each range's bin that holds its rank, from the least to the greatest value in it."""
    distinct = ranges.select(*own, "_low", "_high", "_below").distinct()  # ranks that are still together share their counts
    side = F.broadcast(distinct) if ranges.count() <= BROADCAST_RANGES else distinct
    inside = values.join(side, _same(values, side, own) & (values["_v"] >= side["_low"]) & (values["_v"] <= side["_high"]))
    # the least value falls in the first bin and the greatest in the last, so every round parts a range; halves where its width is beyond the largest number
    width, half = F.col("_high") - F.col("_low"), F.col("_high") / 2 - F.col("_low") / 2
    part = F.when(width < float("inf"), (F.col("_v") - F.col("_low")) / width).otherwise((F.col("_v") / 2 - F.col("_low") / 2) / half)
    binned = inside.select(*[values[o] for o in own], "_v", "_low", "_high", "_below", F.least(F.lit(BINS - 1), F.floor(part * BINS)).alias("_bin"))
    counts = binned.groupBy(*own, "_low", "_high", "_below", "_bin").agg(F.count("*").alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    before = Window.partitionBy(*own, "_low", "_high").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.col("_below") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    on = _same(ranges, counts, [*own, "_low", "_high"]) & (ranges["_rank"] >= counts["_before"]) & (ranges["_rank"] < counts["_before"] + counts["_c"])
    return ranges.join(counts, on).select(*[ranges[o] for o in own], ranges["_rank"], counts["_before"].alias("_below"), counts["_from"].alias("_low"), counts["_to"].alias("_high"))


def agg_exact_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a column in few groups, none of which is held whole."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "median": 0.5, "p90": 0.9, "p999": 0.999, "top": 1.0})
    return found.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p01", "median", "p90", "p999", "top")])


def numeric_histograms(df: DataFrame, key: str, value: str, bins: int) -> DataFrame:
    """(key, bin, centre, height) of an adaptive histogram of at most ``bins`` bins for each key, merged from partial ones."""
    found = df.groupBy(key).agg(F.histogram_numeric(F.col(value).cast("double"), F.lit(bins)).alias("h"))
    return found.select(key, F.posexplode("h").alias("bin", "b")).select(key, "bin", F.col("b.x").alias("centre"), F.col("b.y").alias("height"))


def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each event type's bins hold all its events, and whether the estimated rank of every centre is within a twentieth of the exact one."""
    events = table(spark, sf_dir, "events").select("event_type", "value")
    bins = numeric_histograms(events, "event_type", "value", 40)
    upto = Window.partitionBy("event_type").orderBy("bin")
    ranked = bins.select("event_type", "centre", "height", (F.sum("height").over(upto) - F.col("height") / 2).alias("estimate"))
    # at most 40 centres a type, which each event of the type passes
    exact = events.join(ranked, "event_type").groupBy("event_type", "centre", "height", "estimate").agg(F.count_if(F.col("value") <= F.col("centre")).alias("exact"), F.count("*").alias("n"))
    whole = exact.groupBy("event_type").agg(F.max("n").alias("n"), F.sum("height").alias("held"), F.max(F.abs(F.col("estimate") - F.col("exact"))).alias("off"))
    return whole.select("event_type", "n", (F.round("held").cast("long") == F.col("n")).alias("whole"), (F.col("off") <= F.col("n") / 20).alias("near"))


QUERIES = {f.__name__: f for f in (agg_exact_quantiles, agg_histogram)}
_Q = ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 6) as {name}" for name, p in {"p01": 0.01, "median": 0.5, "p90": 0.9, "p999": 0.999, "top": 1.0}.items())
ORACLES = {
    "agg_exact_quantiles": f"select l_returnflag, {_Q} from lineitem group by 1",
    "agg_histogram": "select event_type, count(*) as n, true as whole, true as near from events group by 1",
}
