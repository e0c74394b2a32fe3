"""Deliveries, expiry of state, the table of current rows and timers, on small streams."""

import datetime

import pytest

from millrace.streaming import arrivals
from millrace.streaming.arrivals import UpdateTable, run_deliveries, timed_sessions

SCHEMA = "event_id long, user_id long, event_type string, ts timestamp, value double"
AT = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def events(spark, rows):
    """Rows of (event, user, hours after the start)."""
    return spark.createDataFrame([(e, u, "click", AT + datetime.timedelta(hours=h), 1.0) for e, u, h in rows], SCHEMA)


def test_state_expires_and_late_rows_drop(spark):
    parts = [events(spark, [(k * 10 + j, 1, k * 48 + j) for j in range(5)]) for k in range(3)]
    parts += [events(spark, [(100, 1, 3), (101, 1, 96.5), (20, 1, 96)])]  # late, in time, a repeat in time
    ran = run_deliveries(parts, lambda s: s.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"]), "t")
    assert sorted(r.event_id for r in ran.result.collect()) == sorted([*range(5), *range(10, 15), *range(20, 25), 101])
    assert ran.late_rows() == 1
    assert ran.state_rows() == [5, 5, 5, 6]
    removed = sum(op["numRowsRemoved"] for b in ran.batches for op in b["stateOperators"])
    assert removed == 10 and {b["delivery"] for b in ran.batches} == {0, 1, 2, 3}


def test_an_append_window_waits_for_the_watermark(spark):
    count = lambda s: s.withWatermark("ts", "1 hour").groupBy(arrivals.F.window("ts", "1 day")).count().select("count")
    ran = run_deliveries([events(spark, [(1, 1, 2), (2, 1, 20)])], count, "t")
    assert ran.result.count() == 0
    ran = run_deliveries([events(spark, [(1, 1, 2), (2, 1, 20)]), events(spark, [(3, 1, 26)]), events(spark, [(4, 1, 5)])], count, "t")
    assert [r["count"] for r in ran.result.collect()] == [2]


def test_update_table(spark):
    kept = UpdateTable(spark, "kept", ["k"], compact_after=2)
    frame = lambda *rows: spark.createDataFrame(rows, "k long, v string")
    kept.write(frame((1, "a"), (2, "a"), (None, "n")), 0)
    assert not kept.bases
    kept.write(frame((2, "b"), (3, "b")), 1)
    assert kept.bases == [1]
    kept.write(frame((1, "wrong")), 2)
    kept.write(frame((1, "c")), 2)  # the batch runs again, as after a lost driver
    assert {r.k: r.v for r in kept.read().collect()} == {1: "c", 2: "b", 3: "b", None: "n"}
    kept.write(frame((4, "d")), 3)
    assert kept.bases == [1, 3] and kept.read().count() == 5
    assert kept.read().columns == ["k", "v"]


def test_timers_close_sessions_whatever_the_order(spark):
    first = events(spark, [(1, 1, 0), (2, 1, 1.0), (3, 2, 0), (4, 1, 0.5)])
    second = events(spark, [(5, 1, 0.75), (6, 1, 1.4), (7, 1, 9)])  # fills and extends the open session out of order
    bridge = events(spark, [(8, 1, 1.85), (9, 1, 2.3), (10, 3, 2)])
    end = events(spark, [(11, 9, 99)])
    ran = timed_sessions([first, second, bridge, end], 30, "12 hours")
    got = sorted((r.user_id, (r.start - int(AT.timestamp() * 1e6)) // 60_000_000, (r["last"] - r.start) // 60_000_000, r.n) for r in ran.result.collect())
    # 0.5 hours are a gap: 0 and 0.5 are two sessions
    assert got == [(1, 0, 0, 1), (1, 30, 108, 6), (1, 540, 0, 1), (2, 0, 0, 1), (3, 120, 0, 1)]
    assert ran.state_rows()[-1] < max(ran.state_rows())


@pytest.mark.parametrize("name", ["stream_late_windows", "stream_update_merge", "stream_state_expiry"])
def test_no_events(spark, tmp_path, name):
    spark.createDataFrame([], "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert arrivals.QUERIES[name](spark, str(tmp_path)).count() == (7 if name == "stream_state_expiry" else 0)
