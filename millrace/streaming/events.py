"""Streams of events: windows, sessions, deduplication, joins and state.

Every query reads the events as a file stream and runs it to its end (``availableNow``). Results that grow with the
input are written as Parquet with a checkpoint in the shared folder, complete ones by their last batch; small complete
results go to a table in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.scratch import scratch_path
from millrace.sources import table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream (a glob, as the table may be one file or a folder of files), with an event time that carries a zone, as watermarks need."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def to_files(stream: DataFrame, name: str) -> DataFrame:
    """Run an append-mode stream to its end into Parquet files, exactly once."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def to_memory(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream of few result rows to its end in complete mode."""
    spark = stream.sparkSession
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", scratch_path(spark, name)).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def to_last_batch(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream of many result rows to its end in complete mode; each batch writes the whole result to a folder of its own, and the last counts."""
    spark = stream.sparkSession
    path, last = scratch_path(spark, name), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[:] = [number]

    stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", scratch_path(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={last[0]}") if last else spark.createDataFrame([], stream.schema)


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))
    return to_memory(daily.select(_text("window.start").alias("start"), "event_type", "n", "value"), "stream_tumbling_rows")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sliding = event_stream(spark, sf_dir).groupBy(F.window("ts", "2 days", "1 day")).agg(F.count("*").alias("n"))
    return to_memory(sliding.select(_text("window.start").alias("start"), "n"), "stream_sliding_rows")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = event_stream(spark, sf_dir).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return to_last_batch(found.select("user_id", _text("session_window.start").alias("start"), "n"), "stream-sessions")


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and type within the watermark."""
    kept = event_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return to_files(kept.select("user_id", "event_type"), "stream-dedup")


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir)
    clicks = events.where("event_type = 'click'").select(F.col("user_id").alias("u"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")).withWatermark("click_ts", "2 hours")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts")).withWatermark("buy_ts", "2 hours")
    joined = clicks.join(buys, F.expr("u = user_id and buy_ts >= click_ts and buy_ts <= click_ts + interval 2 hours"))
    return to_files(joined.select("user_id", "click_id", "buy_id"), "stream-join")


def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    counted = event_stream(spark, sf_dir).join(customer, "user_id").groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    return to_memory(counted, "stream_static_rows")


def stream_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch is written by the batch writer, under its own number, so a repeated batch replaces itself."""
    path = scratch_path(spark, "batches")

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    event_stream(spark, sf_dir).writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "batches-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("event_type").agg(F.sum("n").alias("n"))


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running count and sum for each user in custom state; one row for each user and batch, of which the last counts."""

    def total(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, value = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, value = n + len(frame), value + float(frame.value.sum())
        state.update((n, value))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "value": [value]})

    kept = event_stream(spark, sf_dir).select("user_id", "value").groupBy("user_id").applyInPandasWithState(total, "user_id long, n long, value double", "n long, value double", "append", GroupStateTimeout.NoTimeout)
    return to_files(kept, "stream-state").groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("value", "n"), 4).alias("value"))


QUERIES = {f.__name__: f for f in (stream_tumbling, stream_sliding, stream_sessions, stream_dedup, stream_interval_join, stream_static_join, stream_foreach_batch, stream_state)}
_START = "strftime({}, '%Y-%m-%d %H:%M:%S') as start"
ORACLES = {
    "stream_tumbling": f"select {_START.format('ts::date')}, event_type, count(*) as n, round(sum(value), 2) as value from events group by 1, 2",
    "stream_sliding": f"select {_START.format('d')}, count(*) as n from (select unnest([ts::date, (ts - interval 1 day)::date]) as d from events) group by d",
    "stream_sessions": f"with s as (select *, case when ts - lag(ts) over w < interval 30 minute then 0 else 1 end as b from events window w as (partition by user_id order by ts)), t as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, {_START.format('min(ts)')}, count(*) as n from t group by user_id, k",
    "stream_dedup": "select distinct user_id, event_type from events",
    "stream_interval_join": "select c.user_id, c.event_id as click_id, b.event_id as buy_id from events c join events b on c.user_id = b.user_id and c.event_type = 'click' and b.event_type = 'purchase' and b.ts >= c.ts and b.ts <= c.ts + interval 2 hour",
    "stream_static_join": "select c_mktsegment, count(*) as n from events join customer on user_id = c_custkey group by 1",
    "stream_foreach_batch": "select event_type, count(*) as n from events group by 1",
    "stream_state": "select user_id, count(*) as n, round(sum(value), 4) as value from events group by 1",
}
