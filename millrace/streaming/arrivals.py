"""Streams whose events arrive in several deliveries, some late and some twice: watermarks, expiry of state, update mode, timers.

A delivery is a set of new files in a landing folder. After each one the query runs to its end
(``availableNow``) and starts from its checkpoint at the next, as a job does that runs every hour; state and watermark
live on in the checkpoint. What the engine reports of each batch (late rows dropped, rows of state) is kept beside the result.

A row is late if it is not later than the watermark that earlier deliveries have left: the greatest event time
seen, in milliseconds, less the delay. Windows are late when they end by then.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.scratch import scratch_path
from millrace.sources import table

#: The events come in so many deliveries; those whose id is a multiple of LATE_IDS come LATE_DAYS late.
DELIVERIES = 6
LATE_IDS, LATE_DAYS = 11, 8
DELAY = "1 day"
_DAY = 86_400_000_000


@dataclass
class Deliveries:
    """What a query made of its deliveries: ``result`` (append mode) and the engine's report of each batch, with the number of its delivery."""

    result: DataFrame | None
    batches: list[dict] = field(default_factory=list)

    def late_rows(self) -> int:
        """Rows that stateful operators dropped because of the watermark; of aggregates, rows after the partial aggregation."""
        return sum(op["numRowsDroppedByWatermark"] for b in self.batches for op in b["stateOperators"])

    def state_rows(self) -> list[int]:
        """Rows of state after each delivery."""
        last = {b["delivery"]: sum(op["numRowsTotal"] for op in b["stateOperators"]) for b in self.batches if b["stateOperators"]}
        return [last[k] for k in sorted(last)]


def run_deliveries(deliveries: Iterable[DataFrame], query: Callable[[DataFrame], DataFrame], name: str, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None, **conf: str) -> Deliveries:
    """Let the deliveries land one by one and run ``query`` on the stream of their files after each.

    ``write`` takes each batch with its number; without it the rows are appended as Parquet, exactly once. ``conf`` holds for the query
    only and names settings with ``__`` for dots.
    """
    out, schema, spark = Deliveries(None), None, None
    for k, part in enumerate(deliveries):
        if spark is None:
            spark, schema = part.sparkSession, part.schema
            landing, state, path = (scratch_path(spark, f"{name}-{kind}") for kind in ("landing", "state", "out"))
        part.write.parquet(f"{landing}/d{k:06d}")
        stream = query(spark.readStream.schema(schema).parquet(f"{landing}/*"))
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
        writer = writer.foreachBatch(write) if write else writer.format("parquet").option("path", path)
        with _settings(spark, conf):
            running = writer.start()
            running.awaitTermination()
        out.batches += [json.loads(p.json) | {"delivery": k} for p in running.recentProgress]
        if not write:
            out.result = spark.read.schema(stream.schema).parquet(path)
    return out


class _settings:
    def __init__(self, spark: SparkSession, conf: dict[str, str]):
        self.spark, self.conf = spark, {k.replace("__", "."): v for k, v in conf.items()}

    def __enter__(self) -> None:
        self.before = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_) -> None:
        for k, v in self.before.items():
            self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)


class UpdateTable:
    """The current row of each key, kept by update-mode batches.

    Each batch writes the rows it has updated to a folder of its own number, so that a batch that is run again replaces itself;
    the row of the greatest number counts. After every ``compact_after`` batches the current rows are written as a base
    that later reads start from, so a read takes in one base and few batches.
    """

    def __init__(self, spark: SparkSession, name: str, keys: list[str], compact_after: int = 8):
        self.spark, self.keys, self.compact_after = spark, keys, compact_after
        self.path = scratch_path(spark, name)
        self.bases: list[int] = []
        self.batches: list[int] = []

    def write(self, batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/batch-{number}")
        if number not in self.batches:
            self.batches.append(number)
        if len(self._open()) >= self.compact_after:
            self._current().write.mode("overwrite").parquet(f"{self.path}/base-{number}")
            self.bases.append(number)

    def _open(self) -> list[int]:
        return [b for b in self.batches if b > (self.bases[-1] if self.bases else -1)]

    def _current(self) -> DataFrame:
        """The current rows with the number of the batch that wrote them; one shuffle by key."""
        paths = [f"{self.path}/base-{b}" for b in self.bases[-1:]] + [f"{self.path}/batch-{b}" for b in self._open()]
        rows = self.spark.read.parquet(*paths)
        others = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), "_batch").alias("_row"))
        return last.select(*self.keys, "_row.*")

    def read(self) -> DataFrame:
        return self._current().drop("_batch")


class SessionTimers(StatefulProcessor):
    """Sessions of a key's events by typed state: its open intervals in one value, and one timer, for the first of them to end.

    An event joins all open intervals that lie less than the gap from it, so events may come out of order. When
    the watermark passes an interval's last event by the gap, the session is told and its state goes. Every call of the state is a
    round trip from Python to Spark, so a key makes a few for a batch, whatever the number of its events and sessions.
    """

    def __init__(self, gap_micros: int):
        self.gap = gap_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "starts array<long>, lasts array<long>, counts array<long>")

    def _due(self, last: int) -> int:
        """The first millisecond at which no event of this interval can come any more."""
        return -(-(last + self.gap) // 1000)

    def _spans(self) -> list[tuple[int, int, int]]:
        """The open intervals (start, last, n) in order."""
        found = self.open.get()
        return list(zip(*found, strict=True)) if found else []

    def _keep(self, spans: list[tuple[int, int, int]]) -> None:
        self.open.update(tuple(list(c) for c in zip(*spans, strict=True)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._spans()
        spans: list[tuple[int, int, int]] = []
        for start, last, n in sorted([*before, *((r.t, r.t, 1) for r in rows)]):
            if spans and start < spans[-1][1] + self.gap:
                spans[-1] = (spans[-1][0], max(spans[-1][1], last), spans[-1][2] + n)
            else:
                spans.append((start, last, n))
        self._keep(spans)
        # intervals lie the gap apart, so the first ends first
        was, due = (self._due(x[0][1]) if x else None for x in (before, spans))
        if was != due:
            if was is not None:
                self.handle.deleteTimer(was)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        spans = self._spans()
        left = [s for s in spans if self._due(s[1]) > now]
        if left:
            self._keep(left)
            self.handle.registerTimer(self._due(left[0][1]))
        else:
            self.open.clear()
        for start, last, n in spans[: len(spans) - len(left)]:
            yield Row(user_id=key[0], start=start, last=last, n=n)

    def close(self) -> None:
        pass


def _bounds(events: DataFrame) -> tuple[int, int]:
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return low or 0, high or 0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value")


def late_deliveries(events: DataFrame, n: int = DELIVERIES, twice: Column | None = None, beats: tuple[str, ...] = ("heartbeat",)) -> list[DataFrame]:
    """The events in ``n`` deliveries by arrival, some late, and a last delivery of one event a type of ``beats`` ten days later, which closes all.

    Events for which ``twice`` holds come again in the delivery after their first.
    """
    low, high = _bounds(events)
    arrival = F.unix_micros("ts") - low + F.when(F.col("event_id") % LATE_IDS == 0, LATE_DAYS * _DAY).otherwise(0)
    slice_ = F.least(F.lit(n - 1), F.expr("_arrival * {} div {}".format(n, high - low + 1))).cast("int")
    dealt = events.withColumn("_arrival", arrival).withColumn("_slice", slice_)
    if twice is not None:
        dealt = dealt.withColumn("_slice", F.explode(F.when(twice & (F.col("_slice") < n - 1), F.array("_slice", F.col("_slice") + 1)).otherwise(F.array("_slice"))))
    end = datetime.datetime.fromtimestamp(high // 1_000_000, datetime.UTC) + datetime.timedelta(days=10)
    # users of their own, as a join would filter null ones before the watermark sees them
    beat = events.sparkSession.createDataFrame([(None, -1 - k, b, end, None) for k, b in enumerate(beats)], events.schema)
    return [*[dealt.where(F.col("_slice") == k).select(*events.columns) for k in range(n)], beat]


def _start(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def stream_late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts, told when the watermark closes the day; rows that come for a closed day are dropped."""

    def daily(stream: DataFrame) -> DataFrame:
        counted = stream.withWatermark("ts", DELAY).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
        return counted.select(_start("window.start").alias("start"), "event_type", "n")

    return run_deliveries(late_deliveries(_events(spark, sf_dir)), daily, "late-windows").result


def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows came, were kept and were dropped as late, the last as the engine reports it."""
    ran = run_deliveries(late_deliveries(_events(spark, sf_dir)), lambda s: s.withWatermark("ts", DELAY).dropDuplicates(["event_id", "ts"]), "late-rows")
    came = sum(b["numInputRows"] for b in ran.batches)
    kept = ran.result.agg(F.count("*").alias("n_kept"))
    return kept.select(F.lit(came).cast("long").alias("n_came"), "n_kept", F.lit(ran.late_rows()).cast("long").alias("n_late"))


def stream_redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a fifth come twice, each once: the second finds its id in the state, or is late when that has expired."""
    parts = late_deliveries(_events(spark, sf_dir), twice=F.col("event_id") % 5 == 0)
    ran = run_deliveries(parts, lambda s: s.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"]), "redelivered")
    return ran.result.where("event_id is not null").select("event_id", "event_type")


def stream_state_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of state that deduplication holds after each delivery: ids go when the watermark passes their time by the delay."""
    parts = late_deliveries(_events(spark, sf_dir))
    ran = run_deliveries(parts, lambda s: s.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(["event_id"]), "state-expiry")
    return spark.createDataFrame(list(enumerate(ran.state_rows())), "delivery long, n_state long")


def _clicks_and_buys(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    clicks = stream.where("event_type = 'click'").select(F.col("user_id").alias("clicker"), F.col("event_id").alias("click_id"), F.col("ts").alias("click_ts")).withWatermark("click_ts", DELAY)
    buys = stream.where("event_type = 'purchase'").select(F.col("user_id").alias("buyer"), F.col("event_id").alias("buy_id"), F.col("ts").alias("buy_ts")).withWatermark("buy_ts", DELAY)
    return clicks, buys


def stream_outer_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchases of the two hours after; a click without one is told when the watermark shows that none can come, and its state goes.

    A row is compared with all rows that the other side's state holds by its key. The key is the user and a slot of two hours, so these
    don't grow with the length of a delivery. A purchase stands in its own slot and in the one before, of which a click is in one.
    """

    def joined(stream: DataFrame) -> DataFrame:
        clicks, buys = _clicks_and_buys(stream)
        slot = lambda ts: F.floor(F.unix_micros(ts) / 7_200_000_000)
        clicks, buys = clicks.withColumn("slot", slot("click_ts")), buys.withColumn("buy_slot", F.explode(F.array(slot("buy_ts"), slot("buy_ts") - 1)))
        on = F.expr("clicker = buyer and slot = buy_slot and buy_ts >= click_ts and buy_ts <= click_ts + interval 2 hours")
        return clicks.join(buys, on, "left_outer").select("click_id", "buy_id")

    parts = late_deliveries(_events(spark, sf_dir), beats=("click", "purchase"))
    return run_deliveries(parts, joined, "outer-join").result


def stream_update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by user in update mode: each batch tells the users it has changed, and the table of current rows takes these in."""
    current = UpdateTable(spark, "update-merge", ["user_id"], compact_after=3)
    totals = lambda s: s.where("event_id is not null").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    run_deliveries(late_deliveries(_events(spark, sf_dir)), totals, "update-merge", "update", current.write)
    return current.read()


def timed_sessions(deliveries: list[DataFrame], gap_minutes: int, delay: str = DELAY) -> Deliveries:
    """Sessions of each user's events by typed state and timers, told when the watermark closes them."""

    def sessions(stream: DataFrame) -> DataFrame:
        rows = stream.withWatermark("ts", delay).select("user_id", "ts", F.unix_micros("ts").alias("t"))
        return rows.groupBy("user_id").transformWithState(SessionTimers(gap_minutes * 60_000_000), "user_id long, start long, last long, n long", "append", "eventTime")

    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    return run_deliveries(deliveries, sessions, "timed-sessions", spark__sql__streaming__stateStore__providerClass=rocks)


def stream_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = timed_sessions(late_deliveries(_events(spark, sf_dir)), 30)
    return ran.result.select("user_id", _start(F.timestamp_micros("start")).alias("start"), "n")


QUERIES = {f.__name__: f for f in (stream_late_windows, stream_late_rows, stream_redelivered, stream_state_expiry, stream_outer_join, stream_update_merge, stream_timers)}


def _dealt(first: str, delay_ms: int = 86_400_000) -> str:
    """Common SQL: events with their time in microseconds, their delivery, and the watermark in milliseconds before it, after it, and before it if only ``first`` counts."""
    return f"""
with timed as (select *, epoch_us(ts) as t from events),
arrived as (select *, t - (select min(t) from timed) + case when event_id % {LATE_IDS} = 0 then {LATE_DAYS * _DAY} else 0 end as arrival from timed),
dealt as (select *, least({DELIVERIES - 1}, (arrival * {DELIVERIES}) // ((select max(t) from timed) - (select min(t) from timed) + 1)) as k from arrived),
tops as (select k, max(t) filter (where {first}) // 1000 as top from dealt group by k),
marks as (select k, max(top) over (order by k rows between unbounded preceding and 1 preceding) - {delay_ms} as before from tops),
seen as (select d.*, coalesce(1000 * before, -1) as mark from dealt d join marks using (k))"""


_MARKED = _dealt("true")
_SESSIONS = """
, kept as (select * from seen where t > mark),
begun as (select *, case when t - lag(t) over w < 1800000000 then 0 else 1 end as b from kept window w as (partition by user_id order by t)),
named as (select *, sum(b) over (partition by user_id order by t rows unbounded preceding) as s from begun)
select user_id, strftime(make_timestamp(min(t)), '%Y-%m-%d %H:%M:%S') as start, count(*) as n from named group by user_id, s"""
ORACLES = {
    "stream_late_windows": f"{_MARKED} select strftime(ts::date, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from seen where (t // {_DAY} + 1) * {_DAY} > mark group by 1, 2",
    "stream_late_rows": f"{_MARKED} select count(*) + 1 as n_came, count(*) filter (where t > mark) + 1 as n_kept, count(*) filter (where t <= mark) as n_late from seen",
    "stream_redelivered": f"{_MARKED} select event_id, event_type from seen where t > mark",
    "stream_state_expiry": f"""{_MARKED}, ends as (select k, max(top) over (order by k) * 1000 - {_DAY} as mark from tops)
        select e.k::bigint as delivery, count(*) filter (where s.t > s.mark and s.k <= e.k and s.t + {_DAY} > e.mark) as n_state from ends e, seen s group by 1 union all select {DELIVERIES}, 1""",
    "stream_outer_join": f"""{_dealt("event_type = 'click'").replace("seen as", "c as")}, b_tops as (select k, max(t) filter (where event_type = 'purchase') // 1000 as top from dealt group by k),
        b_marks as (select k, max(top) over (order by k rows between unbounded preceding and 1 preceding) - 86400000 as before from b_tops),
        both_seen as (select c.*, least(mark, coalesce(1000 * before, -1)) as both_mark from c join b_marks using (k)), kept as (select * from both_seen where t > both_mark)
        select x.event_id as click_id, y.event_id as buy_id from (select * from kept where event_type = 'click') x left join (select * from kept where event_type = 'purchase') y on x.user_id = y.user_id and y.t >= x.t and y.t <= x.t + 7200000000""",
    "stream_update_merge": "select user_id, count(*) as n, round(sum(value), 4) as value from events group by 1",
    "stream_timers": _MARKED + _SESSIONS,
}
