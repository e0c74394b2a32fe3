"""Multi-table queries over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import tables


def plan_regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by nation within one region: four joins and a group-by, with the filter on the small side."""
    region, nation, customer, orders, lineitem = tables(spark, sf_dir, "region", "nation", "customer", "orders", "lineitem")
    within = nation.join(region.where("r_regionkey = 2"), nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name")
    buyers = customer.join(within, customer.c_nationkey == within.n_nationkey).select("c_custkey", "n_name")
    sales = orders.select("o_orderkey", "o_custkey").join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = lineitem.select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"))
    return lines.join(sales, lines.l_orderkey == sales.o_orderkey).groupBy("n_name").agg(F.round(F.sum("paid"), 2).alias("revenue"), F.count("*").alias("n_lines"))


QUERIES = {"plan_regional_revenue": plan_regional_revenue}
ORACLES = {
    "plan_regional_revenue": """
        select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*)::bigint as n_lines
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
        where n_regionkey = 2 group by n_name""",
}
