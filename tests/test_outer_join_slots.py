"""The keys of ``stream_outer_join`` hold the rows of a few hours, whatever a user's number of events."""

import datetime

from pyspark.sql import functions as F

from millrace.streaming import arrivals

HOUR = 3_600_000_000


def test_a_slot_is_part_of_the_key(spark, sf_dir, monkeypatch):
    asked = []
    monkeypatch.setattr(arrivals, "run_deliveries", lambda parts, query, *_: (asked.append(query), arrivals.Deliveries(None))[1])
    arrivals.stream_outer_join(spark, sf_dir)
    at = [k * HOUR // 2 for k in range(-9, 10)] + [2 * HOUR - 1, 2 * HOUR + 1, 4 * HOUR - 1, 4 * HOUR + 1]  # on both sides of 1970
    rows = [(2 * k + b, u, kind, t) for u in (1, 2, None) for k, t in enumerate(at) for b, kind in enumerate(("click", "purchase"))]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    start = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC)
    events = spark.createDataFrame([(e, u, kind, start + datetime.timedelta(microseconds=t), 1.0) for e, u, kind, t in rows], "event_id long, user_id long, event_type string, ts timestamp, value double")
    joined = asked[0](events)
    want = []
    for e, u, kind, t in rows:
        if kind == "click":
            want += [(e, b) for b, v, other, s in rows if other == "purchase" and v == u is not None and t <= s <= t + 2 * HOUR] or [(e, None)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in joined.collect())
    # of one user's clicks and purchases, those that meet by key alone are few
    condition = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "(slot#" in condition and "buy_slot#" in condition
    day = spark.range(2000).select("id", F.lit(7).cast("long").alias("user_id"), F.expr("if(id % 2 = 0, 'click', 'purchase')").alias("event_type"), F.timestamp_seconds(F.col("id") * 7200).alias("ts"), F.lit(1.0).alias("value")).withColumnRenamed("id", "event_id")
    assert asked[0](day).agg(F.count("*"), F.count("buy_id")).first() == (1000, 1000)
