"""Streaming windows, sessions and deduplication against batch over the same rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from trackloom.streaming import windows

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_time timestamp, scope string, track_id long, value double"


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture
def stream(spark, tmp_path):
    """Three files of events in order, the last one far later, so that all windows before it close."""
    rows = [(at(k * 3), "s" if k % 3 else "t", k % 4, float(k)) for k in range(40)]
    parts = [rows[:20], rows[20:] + rows[18:22], [(at(100_000), "s", 99, 0.0)], [(at(100_001), "s", 98, 0.0)]]
    for part in parts:
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame = spark.read.schema(EVENTS).parquet(str(tmp_path / "in"))

    def run(f):
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = f(source).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, spark.table("streamed").collect()))

    return run, frame.where(F.col("track_id") < 90)


def test_windows(stream):
    run, rows = stream
    want = rows.groupBy("scope", F.window("event_time", "10 seconds").start.alias("start")).agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"), F.avg("value").alias("mean_value"))
    assert run(windows.stream_windows) == sorted(map(tuple, want.collect()))


def test_sessions(stream):
    run, rows = stream
    want = rows.groupBy("track_id").agg(F.min("event_time").alias("start"), (F.max("event_time") + F.expr("interval 1 hour")).alias("end"), F.count("*").alias("n"))
    assert run(windows.stream_sessions) == sorted(map(tuple, want.collect()))


def test_dedup(stream):
    run, rows = stream
    got = [r for r in run(lambda s: windows.stream_dedup(s, ["scope", "event_time", "track_id"])) if r[2] < 90]
    assert got == sorted(map(tuple, rows.distinct().collect())) and len(got) == 40
