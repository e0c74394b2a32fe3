"""Joins by key, by range and by time, each as a plan that Spark can distribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.scratch import scratch_path
from millrace.sources import table, tables


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carried: list[str], order: str) -> DataFrame:
    """Each row of ``left`` with the columns ``carried`` of the last row of ``right`` that has its key and is not later; nulls where there is none.

    Both sides are stacked and one window over (key, time) carries the last right row on: one shuffle, no pairs. ``order``
    breaks ties among right rows of one time: the greatest wins.
    """
    l_cols = left.columns
    stacked_l = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[order].dataType).alias("_o"), F.struct(*l_cols).alias("_l"), F.lit(None).cast(right.select(F.struct(*carried).alias("r")).schema["r"].dataType).alias("_r"))
    stacked_r = right.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.lit(None).cast(stacked_l.schema["_l"].dataType).alias("_l"), F.struct(*carried).alias("_r"))
    w = Window.partitionBy("_k").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    out = stacked_l.unionByName(stacked_r).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return out.select("_l.*", *[F.col("_r")[c].alias(c) for c in carried])


def asof_join_spread(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carried: list[str], order: str, partitions: int | None = None) -> DataFrame:
    """``asof_join`` for keys that hold a large share of the rows: no task needs all rows of a key.

    Both sides are stacked and range-partitioned by (key, time), so a hot key lies in many partitions, and written with
    their partition's number. A window carries the last right row on within a partition. Only the keys that cross a
    border, of which there are fewer than partitions, take the last right row of earlier partitions from a table of one row for each
    key and partition, whose size that number bounds. A null key or time matches nothing.
    """
    spark = left.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = F.struct(*carried)
    spread = F.xxhash64(*left.columns)  # left rows of one key and time can part, too
    kinds = {"_o": right.schema[order].dataType, "_l": left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType, "_r": right.select(taken.alias("x")).schema["x"].dataType}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    rows_l = left.select(F.col(key).alias("_k"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), none("_o"), spread.alias("_s"), F.struct(*left.columns).alias("_l"), none("_r"))
    usable = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    rows_r = usable.select(F.col(key).alias("_k"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.col(order).alias("_o"), F.lit(0).cast("long").alias("_s"), none("_l"), taken.alias("_r"))
    path = scratch_path(spark, "asof")
    laid = rows_l.unionByName(rows_r).repartitionByRange(n, "_k", "_t", "_side", "_o", "_s").withColumn("_p", F.spark_partition_id())
    laid.write.parquet(path)
    laid = spark.read.schema(laid.schema).parquet(path)

    within = Window.partitionBy("_p", "_k").orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = laid.withColumn("_r", F.last("_r", ignorenulls=True).over(within)).where("_side = 1")
    # one row for each key and partition, of the keys that lie in several partitions
    parts = laid.where("_k is not null").groupBy("_k", "_p").agg(F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_o"))).alias("_last"))
    parts = parts.withColumn("_n", F.count("*").over(Window.partitionBy("_k"))).where("_n > 1")
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_k", "_p", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    out = found.join(F.broadcast(carry), ["_k", "_p"], "left").withColumn("_r", F.when(F.col("_t").isNotNull(), F.coalesce("_r", "_carry")))
    return out.select("_l.*", *[F.col("_r")[c].alias(c) for c in carried])


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, bucket: float) -> DataFrame:
    """Pairs with ``low <= point < high``: ranges are dealt to every bucket they touch, points to their own, and the rest is an equi-join with a filter.

    ``bucket`` should be near the usual length of a range, so that a range touches few buckets.
    """
    p = points.withColumn("_b", F.floor(F.col(point) / bucket))
    r = ranges.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    return p.join(r, "_b").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_b")


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of one key whose right row is at most ``seconds`` after the left row: hash-joined on key and time bucket."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    a = left.withColumn("_b", F.explode(F.array(bucket(left_time), bucket(left_time) + 1)))
    b = right.withColumn("_b", bucket(right_time))
    gap = F.unix_micros(F.col(right_time).cast("timestamp")) - F.unix_micros(F.col(left_time).cast("timestamp"))
    return a.join(b, [key, "_b"]).where((gap >= 0) & (gap <= seconds * 1_000_000)).drop("_b")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An inner or left equi-join on a skewed key: the big side's rows of a key are dealt over ``salts`` tasks, the small side's are repeated."""
    if how not in ("inner", "left"):
        raise ValueError(f"a {how} join would give the repeated rows of the small side several times")
    a = big.withColumn("_s", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    b = small.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return a.join(b, [key, "_s"], how).drop("_s")


def _sum(c: str | Column, name: str, digits: int = 2) -> Column:
    return F.round(F.sum(c), digits).alias(name)


def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation has 25 rows by definition, so its broadcast is bounded."""
    supplier, nation = tables(spark, sf_dir, "supplier", "nation")
    return supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey).groupBy("n_name").agg(_sum("s_acctbal", "balance"), F.count("*").alias("n"))


def join_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return lineitem.join(orders.hint("merge"), lineitem.l_orderkey == orders.o_orderkey).groupBy("o_orderpriority").agg(_sum("l_quantity", "quantity"), F.count("*").alias("n"))


def join_shuffled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, lineitem = tables(spark, sf_dir, "part", "lineitem")
    return lineitem.join(part.hint("shuffle_hash"), lineitem.l_partkey == part.p_partkey).groupBy("p_brand").agg(_sum("l_extendedprice", "price"))


def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    bands = spark.range(0, 40).select(F.col("id").alias("band"), (F.col("id") * 60.0).alias("low"), (F.col("id") * 60.0 + 90).alias("high"))
    return range_join(part, bands, "p_retailprice", "low", "high", 60.0).groupBy("band").agg(F.count("*").alias("n"), _sum("p_retailprice", "price"))


def join_left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    joined = orders.join(lineitem.where("l_quantity > 45"), orders.o_orderkey == lineitem.l_orderkey, "left")
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count("l_orderkey").alias("n_matched"))


def join_right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, supplier = tables(spark, sf_dir, "nation", "supplier")
    return supplier.where("s_acctbal > 5000").join(nation, supplier.s_nationkey == nation.n_nationkey, "right").groupBy("n_name").agg(F.count("s_suppkey").alias("n"))


def join_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    c = customer.groupBy("c_nationkey").agg(F.count("*").alias("n_customers"))
    s = supplier.groupBy("s_nationkey").agg(F.count("*").alias("n_suppliers"))
    return c.join(s, c.c_nationkey == s.s_nationkey, "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), "n_customers", "n_suppliers")


def join_left_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return orders.join(lineitem.where("l_discount > 0.09"), orders.o_orderkey == lineitem.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def join_left_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lineitem = tables(spark, sf_dir, "orders", "lineitem")
    return orders.join(lineitem, orders.o_orderkey == lineitem.l_orderkey, "left_anti").select("o_orderkey", "o_custkey")


def join_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region and nation have 5 and 25 rows by definition."""
    region, nation = tables(spark, sf_dir, "region", "nation")
    return region.crossJoin(nation).select("r_name", "n_name", (F.col("r_regionkey") == F.col("n_regionkey")).alias("inside"))


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last view of the same user before or at its time."""
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join(purchases, views, "user_id", "ts", "view_ts", ["view_id", "view_value"], "view_id").select("event_id", "view_id", F.round("view_value", 4).alias("view_value"))


def join_asof_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``join_asof``, of users of whom one has half of all events."""
    events = table(spark, sf_dir, "events").withColumn("who", F.when(F.col("user_id") % 2 == 0, -1).otherwise(F.col("user_id")))
    purchases = events.where("event_type = 'purchase'").select("event_id", "who", "ts")
    views = events.where("event_type = 'view'").select("who", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return asof_join_spread(purchases, views, "who", "ts", "view_ts", ["view_id", "view_value"], "view_id").select("event_id", "view_id", F.round("view_value", 4).alias("view_value"))


def join_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts"))
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts"))
    return interval_join(clicks, buys, "user_id", "click_ts", "buy_ts", 7200).select("user_id", "click_id", "buy_id")


def join_self_null_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation, with nation 3 turned to null: nulls meet nulls."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr("nullif(s_nationkey, 3)").alias("k"))
    a, b = s.groupBy("k").agg(F.count("*").alias("n")), s.groupBy("k").agg(F.max("s_suppkey").alias("last"))
    return a.join(b, a.k.eqNullSafe(b.k)).select(a.k.alias("k"), "n", "last")


def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, customer = tables(spark, sf_dir, "events", "customer")
    people = customer.select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return salted_join(events.select("user_id", "event_id", "value"), people, "user_id", 4).groupBy("c_mktsegment").agg(F.count("*").alias("n"), _sum("value", "value"))


_ALL = (join_broadcast, join_sort_merge, join_shuffled_hash, join_range, join_left_outer, join_right_outer, join_full_outer, join_left_semi, join_left_anti, join_cross, join_asof, join_asof_hot, join_interval, join_self_null_safe, join_salted)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "join_broadcast": "select n_name, round(sum(s_acctbal), 2) as balance, count(*) as n from supplier join nation on s_nationkey = n_nationkey group by n_name",
    "join_sort_merge": "select o_orderpriority, round(sum(l_quantity), 2) as quantity, count(*) as n from lineitem join orders on l_orderkey = o_orderkey group by o_orderpriority",
    "join_shuffled_hash": "select p_brand, round(sum(l_extendedprice), 2) as price from lineitem join part on l_partkey = p_partkey group by p_brand",
    "join_range": "select band, count(*) as n, round(sum(p_retailprice), 2) as price from part join (select unnest(range(0, 40)) as band) on p_retailprice >= band * 60.0 and p_retailprice < band * 60.0 + 90 group by band",
    "join_left_outer": "select o_orderstatus, count(*) as n, count(l_orderkey) as n_matched from orders left join (select * from lineitem where l_quantity > 45) on o_orderkey = l_orderkey group by o_orderstatus",
    "join_right_outer": "select n_name, count(s_suppkey) as n from (select * from supplier where s_acctbal > 5000) right join nation on s_nationkey = n_nationkey group by n_name",
    "join_full_outer": "select coalesce(c_nationkey, s_nationkey) as nationkey, n_customers, n_suppliers from (select c_nationkey, count(*) as n_customers from customer group by 1) full join (select s_nationkey, count(*) as n_suppliers from supplier group by 1) on c_nationkey = s_nationkey",
    "join_left_semi": "select o_orderpriority, count(*) as n from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_discount > 0.09) group by 1",
    "join_left_anti": "select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "join_cross": "select r_name, n_name, r_regionkey = n_regionkey as inside from region, nation",
    "join_asof": "select p.event_id, v.event_id as view_id, round(v.value, 4) as view_value from (select * from events where event_type = 'purchase') p asof left join (select * from events where event_type = 'view') v on p.user_id = v.user_id and p.ts >= v.ts",
    "join_asof_hot": "with e as (select *, case when user_id % 2 = 0 then -1 else user_id end as who from events) select p.event_id, v.event_id as view_id, round(v.value, 4) as view_value from (select * from e where event_type = 'purchase') p asof left join (select * from e where event_type = 'view') v on p.who = v.who and p.ts >= v.ts",
    "join_interval": "select c.user_id, c.event_id as click_id, b.event_id as buy_id from events c join events b on c.user_id = b.user_id and c.event_type = 'click' and b.event_type = 'purchase' and b.ts >= c.ts and b.ts <= c.ts + interval 2 hour",
    "join_self_null_safe": "with s as (select s_suppkey, nullif(s_nationkey, 3) as k from supplier) select k, count(*) as n, max(s_suppkey) as last from s group by k",
    "join_salted": "select c_mktsegment, count(*) as n, round(sum(value), 2) as value from events join customer on user_id = c_custkey group by 1",
}
