from __future__ import annotations

import uuid
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tidewire.streaming import streams

QUERIES = entry_point.queries()


def split_table(spark, sf, folder, parts=3):
    """The events as a folder of several files."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    e.repartitionByRange(parts, "ts").write.parquet(f"{folder}/events.parquet")
    return folder


def same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(a.columns).collect()), key=repr)


def test_streams_over_a_folder_of_files(spark, sf, tmp_path):
    folder = split_table(spark, sf, str(tmp_path))
    for name in ("stream_hourly", "stream_dedup", "stream_append_events", "stream_append_attempts"):
        assert same(QUERIES[name](spark, folder), QUERIES[name](spark, sf)), name


def test_complete_mode_returns_the_last_result(spark, sf, tmp_path):
    stream = streams.event_stream(spark, split_table(spark, sf, str(tmp_path)), files=1)
    out = streams.drained(streams.hourly(stream), "complete", streams.shared_folder(spark))
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.date_trunc("hour", "ts"), "event_type").agg(F.count("*"))
    assert out.count() == want.count()


def test_no_input_gives_no_rows(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    stream = streams.event_stream(spark, str(tmp_path))
    assert streams.drained(streams.hourly(stream), "complete", streams.shared_folder(spark)).count() == 0
    assert streams.breakers(attempts_of(stream), streams.shared_folder(spark)).count() == 0


def attempts_of(events):
    return events.select(F.col("user_id").alias("source_key"), "event_id", F.when(F.col("event_type") == "error", 0).otherwise(1).alias("success"), "ts")


def write_attempts(spark, folder, rows):
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    frame.repartition(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_breakers_over_several_batches(spark, tmp_path):
    began = datetime(2024, 1, 1)
    marks = {1: "fff|ff", 2: "ffs|f", 3: "sfs|sff", 4: "f|s", 5: "|ffff"}
    n = 0
    for batch in range(2):
        rows = []
        for key, text in marks.items():
            for c in text.split("|")[batch]:
                n += 1
                rows.append((n, began + timedelta(hours=n), key, "error" if c == "f" else "view", 1.0, "{}"))
        write_attempts(spark, str(tmp_path), rows)
    state = streams.breakers(attempts_of(streams.event_stream(spark, str(tmp_path), files=1)), streams.shared_folder(spark))
    got = {r["source_key"]: (r["seen"], r["failures"]) for r in state.collect()}
    assert got == {1: (5, 5), 2: (4, 1), 3: (6, 2), 4: (2, 0), 5: (4, 4)}
    kept = streams.breakers(attempts_of(streams.event_stream(spark, str(tmp_path), files=1)), streams.shared_folder(spark), keep=2)
    assert kept.count() == 2


def test_breaker_states(spark):
    now = datetime(2024, 1, 2)
    rows = [(2, now, "closed"), (3, now - timedelta(seconds=59), "open"), (3, now - timedelta(seconds=60), "half_open")]
    frame = spark.createDataFrame(rows, "failures long, last_at timestamp, want string")
    got = frame.select("want", streams.breaker_state(F.col("failures"), F.col("last_at"), F.lit(now), 3, 60).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_a_periodic_step_runs(spark, sf, tmp_path):
    folder, seen = split_table(spark, sf, str(tmp_path), 2), []
    query = streams.every(streams.event_stream(spark, folder), 1, f"{streams.shared_folder(spark)}/{uuid.uuid4().hex}", lambda batch, number: seen.append(batch.count()))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert sum(seen) == spark.read.parquet(f"{sf}/events.parquet").count()
