"""Aggregation: exact, grouped several ways, filtered, statistical, ordered and approximate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table


def salted_count_distinct(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Exact distinct counts per key for skewed keys: values are made distinct first, dealt by key and value, so no task holds a hot key."""
    return df.select(*keys, value).where(F.col(value).isNotNull()).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def _round(c: Column, name: str, digits: int = 2) -> Column:
    return F.round(c, digits).alias(name)


def agg_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pricing summary of shipped lines."""
    paid = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'2001-06-01 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(_round(F.sum("l_quantity"), "sum_qty"), _round(F.sum(paid), "sum_paid"), _round(F.sum(paid * (1 + F.col("l_tax"))), "sum_charge"), _round(F.avg("l_discount"), "avg_disc", 6), F.count("*").alias("n"))


def agg_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extremes of strings, which Spark aggregates over sorted rows."""
    return table(spark, sf_dir, "part").groupBy("p_size").agg(F.min("p_name").alias("first_name"), F.max("p_type").alias("last_type"))


def agg_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.size(F.collect_set("n_name")).cast("long").alias("n"))


def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return salted_count_distinct(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey", "n_parts")


def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(_round(F.sum("l_quantity"), "quantity"))


def agg_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.groupingSets([[part.p_brand], [part.p_size], []], part.p_brand, part.p_size).agg(F.count("*").alias("n"))


def agg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("n_high"), _round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), "even_value"))


def agg_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_linestatus").agg(_round(F.stddev("l_quantity"), "sd", 6), _round(F.var_pop("l_discount"), "var", 8), _round(F.corr("l_quantity", "l_extendedprice"), "r", 6), _round(F.regr_slope("l_extendedprice", "l_quantity"), "slope", 4), _round(F.covar_samp("l_quantity", "l_tax"), "cov", 6))


def agg_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(_round(F.percentile("value", 0.9), "p90", 6), _round(F.median("value"), "median", 6))


def agg_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third and fourth moments of the population, and the most frequent value (the least of equally frequent ones)."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_linestatus")
    return lines.agg(_round(F.skewness("l_extendedprice"), "skew", 4), _round(F.kurtosis("l_extendedprice"), "kurt", 4), F.mode("l_linenumber", True).cast("long").alias("usual"))


def agg_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts of merged theta and HLL sketches, one for each day as a rollup stores them, and quantiles of a KLL sketch: whether they are near the exact ones."""
    events = table(spark, sf_dir, "events")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", 0.5).alias("p"), F.max("value").alias("top"), F.expr("kll_sketch_get_quantile_double(kll_sketch_agg_double(value), 0.5D)").alias("q"))
    days = events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.expr("theta_sketch_agg(user_id)").alias("t"), F.hll_sketch_agg("user_id", 12).alias("h"))
    merged = days.groupBy("event_type").agg(F.expr("theta_sketch_estimate(theta_union_agg(t))").alias("t"), F.hll_sketch_estimate(F.hll_union_agg("h")).alias("h"))
    near = lambda c, of, most: F.abs(F.col(c) - F.col(of)) <= most
    tenth = F.col("users") / 10
    return exact.join(merged, "event_type").select("event_type", near("t", "users", tenth).alias("theta_near"), near("h", "users", tenth).alias("hll_near"), near("q", "p", F.col("top") / 25).alias("kll_near"))


def agg_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent event types by a bounded sketch, exact while there are few distinct values."""
    found = table(spark, sf_dir, "events").agg(F.expr("approx_top_k(event_type, 5)").alias("top"))
    return found.select(F.inline("top")).select(F.col("item").alias("event_type"), F.col("count").cast("long").alias("n"))


def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate counts and whether they are within a tenth of the exact ones."""
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"), F.approx_count_distinct("l_partkey", 0.02).alias("m"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 14)).alias("h"))
    near = lambda c: F.abs(F.col(c) - F.col("n")) <= F.col("n") / 10
    return exact.select("l_returnflag", near("m").alias("near"), near("h").alias("sketch_near"))


def agg_approx_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.percentile("value", 0.5).alias("p"), F.percentile_approx("value", 0.5, 10000).alias("q"), F.max("value").alias("top"))
    return events.select("event_type", (F.abs(F.col("p") - F.col("q")) <= F.col("top") / 50).alias("near"))


def agg_merged_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users over all days from one sketch for each day, as a rollup would store them."""
    days = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("s"))
    return days.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("users"))


def agg_merged_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By event type, the users over all days from one sketch a day, and whether that is within a tenth of the exact number."""
    events = table(spark, sf_dir, "events")
    days = events.groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.hll_sketch_agg("user_id", 12).alias("s"))
    merged = days.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("m"), F.count("*").alias("n_days"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return merged.join(exact, "event_type").select("event_type", "n_days", "users", (F.abs(F.col("m") - F.col("users")) <= F.col("users") / 10).alias("near"))


def agg_any_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some order of each customer: which one is open, so what is told is that it is one of the customer's."""
    orders = table(spark, sf_dir, "orders")
    some = orders.groupBy("o_custkey").agg(F.any_value("o_orderkey").alias("some"), F.count("*").alias("n"))
    own = some.join(orders.select(F.col("o_orderkey").alias("some"), F.col("o_custkey").alias("of")), "some", "left")
    return own.select("o_custkey", "n", (F.col("of") == F.col("o_custkey")).alias("own"))


def agg_heavy_hitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(10)


def agg_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation_names")
    return spark.sql("select n_regionkey, listagg(n_name, '|') within group (order by n_name desc) as names from nation_names group by n_regionkey")


def agg_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("dearest"), F.min_by("o_custkey", F.struct("o_totalprice", "o_orderkey")).alias("cheapest_buyer"))


_ALL = (agg_hash, agg_sort, agg_collect, agg_count_distinct, agg_rollup, agg_cube, agg_grouping_sets, agg_filtered, agg_statistics, agg_percentiles, agg_shape, agg_sketches, agg_top_values, agg_approx_distinct, agg_approx_percentile, agg_merged_sketches, agg_merged_near, agg_any_value, agg_heavy_hitters, agg_string, agg_arg_max)
QUERIES = {f.__name__: f for f in _ALL}
_PAID = "l_extendedprice * (1 - l_discount)"
ORACLES = {
    "agg_hash": f"select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum({_PAID}), 2) as sum_paid, round(sum({_PAID} * (1 + l_tax)), 2) as sum_charge, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '2001-06-01' group by all",
    "agg_sort": "select p_size, min(p_name) as first_name, max(p_type) as last_type from part group by p_size",
    "agg_collect": "select n_regionkey, string_agg(n_name, ',' order by n_name) as names, count(distinct n_name) as n from nation group by 1",
    "agg_count_distinct": "select l_returnflag, count(distinct l_partkey) as n_parts from lineitem group by 1",
    "agg_rollup": "select o_orderstatus, o_orderpriority, count(*) as n, grouping_id(o_orderstatus, o_orderpriority)::bigint as level from orders group by rollup (o_orderstatus, o_orderpriority)",
    "agg_cube": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as quantity from lineitem group by cube (l_returnflag, l_linestatus)",
    "agg_grouping_sets": "select p_brand, p_size, count(*) as n from part group by grouping sets ((p_brand), (p_size), ())",
    "agg_filtered": "select event_type, count(*) filter (where value > 50) as n_high, round(sum(value) filter (where user_id % 2 = 0), 2) as even_value from events group by 1",
    "agg_statistics": "select l_linestatus, round(stddev(l_quantity), 6) as sd, round(var_pop(l_discount), 8) as var, round(corr(l_quantity, l_extendedprice), 6) as r, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(covar_samp(l_quantity, l_tax), 6) as cov from lineitem group by 1",
    "agg_percentiles": "select event_type, round(quantile_cont(value, 0.9), 6) as p90, round(median(value), 6) as median from events group by 1",
    "agg_shape": "with m as (select l_linestatus, avg(l_extendedprice) as a from lineitem group by 1), c as (select l_linestatus, avg((l_extendedprice - a) ** 2) as m2, avg((l_extendedprice - a) ** 3) as m3, avg((l_extendedprice - a) ** 4) as m4 from lineitem join m using (l_linestatus) group by 1), k as (select l_linestatus, l_linenumber, row_number() over (partition by l_linestatus order by count(*) desc, l_linenumber) as r from lineitem group by 1, 2) select l_linestatus, round(m3 / m2 ** 1.5, 4) as skew, round(m4 / m2 ** 2 - 3, 4) as kurt, l_linenumber::bigint as usual from c join k using (l_linestatus) where r = 1",
    "agg_sketches": "select distinct event_type, true as theta_near, true as hll_near, true as kll_near from events",
    "agg_top_values": "select event_type, count(*) as n from events group by 1 order by n desc limit 5",
    "agg_approx_distinct": "select distinct l_returnflag, true as near, true as sketch_near from lineitem",
    "agg_approx_percentile": "select distinct event_type, true as near from events",
    "agg_merged_near": "select event_type, count(distinct ts::date) as n_days, count(distinct user_id) as users, true as near from events group by 1",
    "agg_any_value": "select o_custkey, count(*) as n, true as own from orders group by 1",
    "agg_heavy_hitters": "select l_suppkey, count(*) as n from lineitem group by 1 order by n desc, l_suppkey limit 10",
    "agg_string": "select n_regionkey, string_agg(n_name, '|' order by n_name desc) as names from nation group by 1",
    "agg_arg_max": "select o_orderpriority, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as dearest, arg_min(o_custkey, (o_totalprice, o_orderkey)) as cheapest_buyer from orders group by 1",
}
