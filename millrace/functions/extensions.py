"""Vectorised Python extensions: scalar and aggregate Pandas functions, table functions, grouped, co-grouped and partition maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import table, tables


#: How Spark merges two partial states of a field.
MERGES = {"sum": F.sum, "min": F.min, "max": F.max, "and": F.bool_and, "or": F.bool_or, "bits": F.bit_or}


def mergeable_aggregate(df: DataFrame, key: str, inputs: list[str], fields: dict[str, tuple[str, str]], update: Callable[[pd.DataFrame], pd.DataFrame], finish: dict[str, Column]) -> DataFrame:
    """An aggregate in Python whose groups never pass whole through a worker.

    ``update`` takes a batch of rows (key and inputs) and gives one row of partial state for each key in it; ``fields`` names the
    state's columns with their types and how two states merge (a name of ``MERGES``); Spark merges the states, first within the
    map tasks and then by key; ``finish`` makes the results from the merged fields. A state is a fixed number of fields, so
    a hot key costs its shuffle one row a task.
    """
    unknown = {how for _, how in fields.values()} - MERGES.keys()
    if unknown:
        raise ValueError(f"no merge is called {sorted(unknown)}")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield update(batch)[[key, *fields]]

    kind = df.schema[key].dataType.simpleString()
    states = df.select(key, *inputs).mapInPandas(partial, ", ".join([f"`{key}` {kind}", *[f"`{c}` {t}" for c, (t, _) in fields.items()]]))
    merged = states.groupBy(key).agg(*[MERGES[how](c).alias(c) for c, (_, how) in fields.items()])
    return merged.select(key, *[c.alias(name) for name, c in finish.items()])


def ext_mergeable_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of logarithms and of reciprocals, and the spread, by event type, from partial states of each batch."""

    def update(batch: pd.DataFrame) -> pd.DataFrame:
        x = batch.value
        state = pd.DataFrame({"event_type": batch.event_type, "n": x.notna().astype("int64"), "logs": np.log1p(x.clip(lower=0)), "inverse": 1 / (1 + x.abs()), "low": x, "high": x})
        return state.groupby("event_type", dropna=False, as_index=False).agg({"n": "sum", "logs": "sum", "inverse": "sum", "low": "min", "high": "max"})

    fields = {"n": ("long", "sum"), "logs": ("double", "sum"), "inverse": ("double", "sum"), "low": ("double", "min"), "high": ("double", "max")}
    finish = {"mean_log": F.round(F.col("logs") / F.col("n"), 8), "harmonic": F.round(F.col("n") / F.col("inverse"), 6), "spread": F.round(F.col("high") - F.col("low"), 6)}
    return mergeable_aggregate(table(spark, sf_dir, "events"), "event_type", ["value"], fields, update, finish)


def ext_pandas_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def squashed(x: pd.Series) -> pd.Series:
        return (x / (1 + x.abs())).round(8)

    return table(spark, sf_dir, "events").select("event_id", squashed("value").alias("squashed"))


def ext_pandas_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return round(float(x.max() - x.min()), 6)

    return table(spark, sf_dir, "part").groupBy("p_brand").agg(spread("p_retailprice").alias("spread"))


def ext_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python table function, called laterally for each nation."""

    @F.udtf(returnType="letter string, n int")
    class Letters:
        def eval(self, text: str):
            for letter in sorted(set(text or "")):
                yield letter, text.count(letter)

    spark.udtf.register("letters_of", Letters)
    table(spark, sf_dir, "nation").createOrReplaceTempView("udtf_nation")
    return spark.sql("select n_nationkey, letter, cast(n as bigint) as n from udtf_nation, lateral letters_of(n_name)")


def ext_grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events less the user's mean; a group is one user's events."""

    def centred(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"event_id": group.event_id, "centred": (group.value - group.value.mean()).round(8)})

    return table(spark, sf_dir, "events").select("user_id", "event_id", "value").groupBy("user_id").applyInPandas(centred, "event_id long, centred double")


def ext_cogrouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, supplier = tables(spark, sf_dir, "customer", "supplier")

    def balance(key: tuple, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"nation": [key[0]], "balance": [round(float(c.c_acctbal.sum() - s.s_acctbal.sum()), 2)]})

    left = customer.select("c_nationkey", "c_acctbal").groupBy("c_nationkey")
    return left.cogroup(supplier.select("s_nationkey", "s_acctbal").groupBy("s_nationkey")).applyInPandas(balance, "nation int, balance double")


def ext_partition_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per batch, added up by Spark."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.groupby("lang").size().rename("n").reset_index()

    return table(spark, sf_dir, "documents").select("lang").mapInPandas(count, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


_ALL = (ext_pandas_udf, ext_pandas_aggregate, ext_mergeable_aggregate, ext_table_function, ext_grouped_map, ext_cogrouped_map, ext_partition_map)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = {
    "ext_pandas_udf": "select event_id, round(value / (1 + abs(value)), 8) as squashed from events",
    "ext_pandas_aggregate": "select p_brand, round(max(p_retailprice) - min(p_retailprice), 6) as spread from part group by 1",
    "ext_mergeable_aggregate": "select event_type, round(sum(ln(1 + greatest(value, 0))) / count(*), 8) as mean_log, round(count(*) / sum(1 / (1 + abs(value))), 6) as harmonic, round(max(value) - min(value), 6) as spread from events group by 1",
    "ext_table_function": "select n_nationkey, letter, count(*) as n from (select n_nationkey, unnest(string_split(n_name, '')) as letter from nation) group by all",
    "ext_grouped_map": "select event_id, round(value - avg(value) over (partition by user_id), 8) as centred from events",
    "ext_cogrouped_map": "select coalesce(c_nationkey, s_nationkey) as nation, round(coalesce(c, 0) - coalesce(s, 0), 2) as balance from (select c_nationkey, sum(c_acctbal) as c from customer group by 1) full join (select s_nationkey, sum(s_acctbal) as s from supplier group by 1) on c_nationkey = s_nationkey",
    "ext_partition_map": "select lang, count(*) as n from documents group by 1",
}
