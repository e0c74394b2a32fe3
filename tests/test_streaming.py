"""Where the results of streams are kept."""

import datetime

from millrace.streaming import events


def test_sessions_stay_out_of_the_driver(spark, tmp_path, monkeypatch):
    """Sessions are about as many as events: none may pass through the memory sink, and late rows still join their sessions."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(k, k % 3, "click", at + datetime.timedelta(hours=k), 1.0) for k in range(40)]
    late = [(100, 0, "click", at + datetime.timedelta(minutes=10), 1.0), (101, 0, "click", at + datetime.timedelta(hours=3, minutes=29), 1.0)]
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"
    for part in (rows, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(events, "to_memory", None)
    stream = events.event_stream

    def one_file_a_batch(session, sf_dir):
        fields = stream(session, sf_dir).schema
        return session.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")

    monkeypatch.setattr(events, "event_stream", one_file_a_batch)
    got = events.stream_sessions(spark, str(tmp_path))
    assert "parquet" in got.inputFiles()[0]
    found = {(r.user_id, r.start): r.n for r in got.collect()}
    assert len(found) == 40 and found[0, "2024-01-01 00:00:00"] == 2 and found[0, "2024-01-01 03:00:00"] == 2
    assert sum(found.values()) == 42


def test_no_events(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/events.parquet")
    assert events.stream_sessions(spark, str(tmp_path)).count() == 0
