"""Writing a table in one of Spark's formats and reading it back; inline rows and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import scratch_path
from millrace.sources.tables import table


def round_trip(df: DataFrame, kind: str, **options: str) -> DataFrame:
    """``df`` written to a new folder and read back with its own schema, so that nothing is inferred."""
    path = scratch_path(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path)


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")


def source_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned sink, of which the read prunes all folders but one."""
    path = scratch_path(spark, "partitioned")
    _orders(spark, sf_dir).write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(path).where("o_orderstatus = 'O'").select("o_orderkey", "o_orderstatus", "o_totalprice")


def source_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "orc")


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "json")


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "csv", header="true")


def source_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_orders(spark, sf_dir), "xml", rowTag="order")


def source_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline rows that name some order states, against all orders."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("inline_orders")
    return spark.sql("""
        select state, name, count(o_orderkey) as n from values ('F', 'filled'), ('O', null), ('?', 'unknown') as t(state, name)
        left join inline_orders on o_orderstatus = state group by state, name""")


def source_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of numbers against all line quantities: also those that no line has."""
    quantities = spark.range(0, 100, 5).select(F.col("id").alias("k"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("k")).agg(F.count("*").alias("n"))
    return quantities.join(lines, "k", "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def source_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reproducible sample of about a tenth."""
    return table(spark, sf_dir, "lineitem").sample(0.1, seed=7).select("l_orderkey")


def source_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether samples of a tenth, by order state, are within four standard deviations of a tenth of the rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderstatus")
    sampled = orders.sample(0.1, seed=7).groupBy("o_orderstatus").agg(F.count("*").alias("m"))
    sizes = orders.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    off = F.abs(F.coalesce("m", F.lit(0)) - F.col("n") / 10)
    return sizes.join(sampled, "o_orderstatus", "left").select("o_orderstatus", "n", (off <= 4 * F.sqrt(F.col("n") * 0.09)).alias("near"))


QUERIES = {f.__name__: f for f in (source_parquet, source_orc, source_json, source_csv, source_xml, source_values, source_range, source_sample, source_sample_size)}
_ORDERS = "select o_orderkey, o_orderstatus, o_totalprice from orders"
ORACLES = {
    "source_parquet": f"{_ORDERS} where o_orderstatus = 'O'",
    "source_orc": _ORDERS,
    "source_json": _ORDERS,
    "source_csv": _ORDERS,
    "source_xml": _ORDERS,
    "source_values": "select state, name, count(o_orderkey) as n from (values ('F', 'filled'), ('O', null), ('?', 'unknown')) t(state, name) left join orders on o_orderstatus = state group by all",
    "source_range": "select k, count(l_quantity) as n from (select unnest(range(0, 100, 5)) as k) left join lineitem on trunc(l_quantity)::bigint = k group by k",
    "source_sample_size": "select o_orderstatus, count(*) as n, true as near from orders group by 1",
}
