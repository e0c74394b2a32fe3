"""Window functions, sorting, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.sources import table, tables


def top_n(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rn") <= n)


def sessions(events: DataFrame, gap_minutes: int) -> DataFrame:
    """Events with the number of their user's session: a pause of ``gap_minutes`` or more starts a new one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pause = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    starts = F.when(pause.isNull() | (pause >= gap_minutes * 60_000_000), 1).otherwise(0)
    return events.withColumn("_s", starts).withColumn("session", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def range_frame(df: DataFrame, keys: list[str], order: str, below: int, above: int, sums: dict[str, str], count: str) -> DataFrame:
    """``df`` with sums and a count over the rows of the same keys whose long ``order`` is at most ``below`` less and ``above`` more.

    ``sums`` maps value columns to the names of their sums. What a RANGE frame gives depends on the keys and the order only, so rows are
    added up by these first (before the shuffle, too). Values of the order are dealt to blocks as long as the frame, so a frame is the
    end of one block and the beginning of the next: running sums from either border give both in one pass, however many rows a frame
    holds, and nothing is subtracted. A key spreads over as many tasks as it has blocks. Rows whose order is null frame each other.
    """
    length = below + above + 1
    by = [F.col(k) for k in keys]
    parts = df.groupBy(*by, F.col(order).alias("_o")).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_{name}") for c, name in sums.items()])
    block = lambda c: F.floor(c / F.lit(length))
    o, least, most = F.col("_o"), F.col("_o") - below, F.col("_o") + above
    # a value stands at its own place (mark 0) and asks at the last place of its frame for the sum up to there (1), at the first for that from there (2)
    place = lambda at, mark: F.struct(at.alias("_at"), F.lit(mark).alias("_mark"))
    # a frame that begins with a block is that block alone
    asks = F.when(block(least) == block(most), F.array(place(o, 0), place(most, 1))).otherwise(F.array(place(o, 0), place(most, 1), place(least, 2)))
    dealt = parts.where("_o is not null").withColumn("_p", F.explode(asks)).withColumns({"_at": F.col("_p._at"), "_mark": F.col("_p._mark")}).withColumn("_block", block(F.col("_at")))
    totals = {count: "_n", **{name: f"_{name}" for name in sums.values()}}
    counted = lambda c: F.when(F.col("_mark") == 0, F.col(c))
    border = Window.partitionBy(*keys, "_block")
    ahead, back = (border.orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow) for at in (F.asc("_at"), F.desc("_at")))
    sides = dealt.select(*keys, "_o", "_mark", *[F.when(F.col("_mark") == 1, F.sum(counted(c)).over(ahead)).otherwise(F.sum(counted(c)).over(back)).alias(name) for name, c in totals.items()])
    own = sides.where("_mark > 0").groupBy(*by, "_o").agg(*[F.sum(name).alias(name) for name in totals])
    own = own.unionByName(parts.where("_o is null").select(*keys, "_o", *[F.col(c).alias(name) for name, c in totals.items()]))
    names = [f"_key{i}" for i in range(len(keys))]
    own = own.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_o", count, *sums.values())
    same = F.col(order).eqNullSafe(F.col("_o"))
    for k, n in zip(keys, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return df.join(own, same, "left").select(*df.columns, count, *sums.values())


def win_row_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w).cast("long").alias("rn"), F.ntile(4).over(w).cast("long").alias("quartile"))


def win_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy("p_size")
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.round(F.percent_rank().over(w), 8).alias("percent"), F.round(F.cume_dist().over(w), 8).alias("cume"))


def win_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.lead("o_orderkey", 2).over(w).alias("second_next"), F.first("o_orderkey").over(whole).alias("first"), F.nth_value("o_orderkey", 2).over(whole).alias("second"))


def win_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    value = Window.partitionBy("event_type").orderBy("user_id").rangeBetween(-5, 5)
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.round(F.sum("value").over(by.rowsBetween(-2, 0)), 4).alias("last_three"), F.count("*").over(value).alias("near_users"))


def win_range_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the same type from six hours before to one hour after each event: five types, spread over many tasks."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    hour = 3_600_000_000
    framed = range_frame(events, ["event_type"], "t", 6 * hour, hour, {"value": "near_value"}, "n_near")
    return framed.select("event_id", "n_near", F.round("near_value", 3).alias("near_value"))


def win_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)


def win_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(table(spark, sf_dir, "events"), 30)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def win_qualify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What QUALIFY says elsewhere: a filter on a window function, as a subquery."""
    w = Window.partitionBy("p_brand")
    part = table(spark, sf_dir, "part").withColumn("dearest", F.max("p_retailprice").over(w))
    return part.where("p_retailprice = dearest").select("p_partkey", "p_brand")


def sort_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc_nulls_last("s_acctbal"), "s_suppkey")


def sort_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def sort_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy("c_acctbal", "c_custkey").offset(50).limit(25)


def _keys(spark, sf_dir):
    events, customer = tables(spark, sf_dir, "events", "customer")
    return events.select(F.col("user_id").alias("k")), customer.select(F.col("c_custkey").alias("k"))


def set_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).groupBy("k").agg(F.count("*").alias("n"))


def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


def set_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")
    c = customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.lit("c").alias("kind"))
    return c.unionByName(supplier.select(F.lit("s").alias("kind"), F.col("s_suppkey").alias("key")), allowMissingColumns=True)


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b.union(b)).groupBy("k").agg(F.count("*").alias("n"))


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return b.subtract(a)


def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b).groupBy("k").agg(F.count("*").alias("n"))


def set_drop_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").dropDuplicates()


_ALL = (win_row_number, win_ranks, win_offsets, win_frames, win_range_spread, win_top_n, win_sessions, win_qualify, sort_global, sort_top_k, sort_offset, set_union_all, set_union_distinct, set_union_by_name, set_intersect, set_intersect_all, set_except, set_except_all, set_drop_duplicates)
QUERIES = {f.__name__: f for f in _ALL}
_A, _B = "select user_id as k from events", "select c_custkey as k from customer"
ORACLES = {
    "win_row_number": "select c_custkey, row_number() over w as rn, ntile(4) over w as quartile from customer window w as (partition by c_nationkey order by c_acctbal desc, c_custkey)",
    "win_ranks": "select p_partkey, rank() over w as rank, dense_rank() over w as dense, round(percent_rank() over w, 8) as percent, round(cume_dist() over w, 8) as cume from part window w as (partition by p_brand order by p_size)",
    "win_offsets": "select o_orderkey, lag(o_orderkey) over w as before, lead(o_orderkey, 2) over w as second_next, first_value(o_orderkey) over v as first, nth_value(o_orderkey, 2) over v as second from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey), v as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)",
    "win_frames": "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 4) as last_three, count(*) over (partition by event_type order by user_id range between 5 preceding and 5 following) as near_users from events",
    "win_range_spread": "select event_id, count(*) over w as n_near, round(sum(value) over w, 3) as near_value from events window w as (partition by event_type order by ts range between interval 6 hours preceding and interval 1 hour following)",
    "win_top_n": "select o_custkey, o_orderkey, o_totalprice, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders qualify rn <= 2",
    "win_sessions": "with s as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as b from events window w as (partition by user_id order by ts, event_id)), t as (select *, (sum(b) over (partition by user_id order by ts, event_id rows unbounded preceding))::bigint as session from s) select user_id, session, count(*) as n, round(sum(value), 4) as value from t group by all",
    "win_qualify": "select p_partkey, p_brand from part qualify p_retailprice = max(p_retailprice) over (partition by p_brand)",
    "sort_global": "select s_suppkey, s_acctbal from supplier order by s_acctbal desc nulls last, s_suppkey",
    "sort_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "sort_offset": "select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 25 offset 50",
    "set_union_all": f"select k, count(*) as n from ({_A} union all {_B}) group by k",
    "set_union_distinct": f"{_A} union {_B}",
    "set_union_by_name": "select c_custkey as key, c_acctbal as balance, 'c' as kind from customer union all select s_suppkey, null, 's' from supplier",
    "set_intersect": f"{_A} intersect {_B}",
    "set_intersect_all": f"select k, count(*) as n from ({_A} intersect all (select k from ({_B}) union all select k from ({_B}))) group by k",
    "set_except": f"{_B} except {_A}",
    "set_except_all": f"select k, count(*) as n from ({_A} except all {_B}) group by k",
    "set_drop_duplicates": "select distinct l_orderkey, l_linenumber from lineitem",
}
