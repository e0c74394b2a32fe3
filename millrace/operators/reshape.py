"""Projection, filters, conditionals, explode, pivot, lateral and recursive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table


def shape_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"), (F.col("l_quantity") >= 25).alias("bulk"))


def shape_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wanted = F.col("p_size").between(5, 15) & ~F.col("p_brand").isin("Brand#11", "Brand#12") & F.col("p_name").isNotNull() | (F.col("p_retailprice") > 1900)
    return part.where(wanted).select("p_partkey", "p_size", "p_brand")


def shape_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.where(F.col("p_type").like("%A%") | F.col("p_name").rlike("[0-9]*7$")).select("p_partkey", F.col("p_name").startswith("part").alias("named"))


def shape_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_acctbal")
    band = F.when(c < 0, "debt").when(c < 3000, "low").when(c < 7000, "middle").otherwise("high")
    return table(spark, sf_dir, "customer").select("c_custkey", band.alias("band"), F.coalesce(F.expr("nullif(c_nationkey, 7)"), F.lit(-1)).alias("nation"))


def shape_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_type", " ")).alias("pos", "word"))
    return words.select("p_partkey", F.col("pos").cast("long").alias("pos"), "word")


def shape_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def shape_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_tax"), 2).alias("tax"))
    return lines.unpivot("l_returnflag", ["quantity", "tax"], "measure", "total")


def shape_lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated subquery per nation, which Spark turns into a join."""
    table(spark, sf_dir, "nation").createOrReplaceTempView("lateral_nation")
    table(spark, sf_dir, "customer").createOrReplaceTempView("lateral_customer")
    return spark.sql("select n_name, s.n, s.top from lateral_nation, lateral (select count(*) as n, max(c_acctbal) as top from lateral_customer where c_nationkey = n_nationkey) s")


def shape_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days up to the last order of 1995's first quarter, with their orders."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("recursive_orders")
    return spark.sql("""
        with recursive days(d) as (select date'1995-01-01' union all select date_add(d, 1) from days where d < date'1995-03-31')
        select cast(d as string) as day, count(o_orderkey) as n from days left join recursive_orders on cast(o_orderdate as date) = d group by d""")


def shape_pipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("piped_lines")
    return spark.sql("from piped_lines |> where l_quantity > 10 |> aggregate count(*) as n, round(sum(l_tax), 2) as tax group by l_returnflag |> where n > 0")


def shape_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("subquery_part")
    return spark.sql("select p_partkey, p_brand from subquery_part a where p_retailprice > (select avg(p_retailprice) * 1.05 from subquery_part b where b.p_brand = a.p_brand)")


_ALL = (shape_project, shape_filter, shape_patterns, shape_conditional, shape_explode, shape_pivot, shape_unpivot, shape_lateral, shape_recursive, shape_pipe, shape_scalar_subquery)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "shape_project": "select l_orderkey, l_extendedprice * (1 - l_discount) as paid, l_quantity >= 25 as bulk from lineitem",
    "shape_filter": "select p_partkey, p_size, p_brand from part where (p_size between 5 and 15 and p_brand not in ('Brand#11', 'Brand#12') and p_name is not null) or p_retailprice > 1900",
    "shape_patterns": "select p_partkey, starts_with(p_name, 'part') as named from part where p_type like '%A%' or regexp_matches(p_name, '[0-9]*7$')",
    "shape_conditional": "select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal < 3000 then 'low' when c_acctbal < 7000 then 'middle' else 'high' end as band, coalesce(nullif(c_nationkey, 7), -1) as nation from customer",
    "shape_explode": "select p_partkey, generate_subscripts(string_split(p_type, ' '), 1) - 1 as pos, unnest(string_split(p_type, ' ')) as word from part",
    "shape_pivot": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P from orders group by 1",
    "shape_unpivot": "with s as (select l_returnflag, round(sum(l_quantity), 2) as quantity, round(sum(l_tax), 2) as tax from lineitem group by 1) select l_returnflag, 'quantity' as measure, quantity as total from s union all select l_returnflag, 'tax', tax from s",
    "shape_lateral": "select n_name, count(c_custkey) as n, max(c_acctbal) as top from nation left join customer on c_nationkey = n_nationkey group by n_name",
    "shape_recursive": "select cast(d::date as varchar) as day, count(o_orderkey) as n from (select unnest(generate_series(date '1995-01-01', date '1995-03-31', interval 1 day)) as d) left join orders on o_orderdate::date = d::date group by d",
    "shape_pipe": "select l_returnflag, count(*) as n, round(sum(l_tax), 2) as tax from lineitem where l_quantity > 10 group by 1",
    "shape_scalar_subquery": "select p_partkey, p_brand from part a where p_retailprice > (select avg(p_retailprice) * 1.05 from part b where b.p_brand = a.p_brand)",
}
