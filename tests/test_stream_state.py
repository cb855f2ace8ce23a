"""Streams that go on where they ended, state by key, windows that close."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.streaming import state, streams

BEGAN = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def write(spark, folder, rows):
    """Rows (event_id, minutes, user, type) as one more file of the events."""
    made = [(n, BEGAN + timedelta(minutes=m), user, kind, 1.0, "{}") for n, m, user, kind in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def events(spark, folder):
    return streams.event_stream(spark, str(folder), files=1)


def attempts(spark, folder):
    return events(spark, folder).select(F.col("user_id").alias("source_key"), "event_id", F.when(F.col("event_type") == "f", 0).otherwise(1).alias("success"), "ts")


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_a_second_run_reads_new_files_only(spark, tmp_path):
    home, seen = streams.shared_folder(spark), []
    write(spark, tmp_path, [(1, 0, 1, "a"), (2, 1, 1, "b")])

    def run():
        kept = events(spark, tmp_path).select("event_id")
        out = rows_of(streams.drained(kept, "append", home, name))
        seen.append(out)

    name = f"again-{tmp_path.name}"
    run()
    write(spark, tmp_path, [(3, 2, 1, "a")])
    run()
    run()
    assert seen == [[(1,), (2,)], [(1,), (2,), (3,)], [(1,), (2,), (3,)]]
    assert streams.versions(spark, f"{home}/stream-{name}/out") == [0, 1]


def test_a_batch_that_stops_before_its_commit_is_written_once(spark, tmp_path):
    write(spark, tmp_path, [(1, 0, 1, "a")])
    write(spark, tmp_path, [(2, 1, 1, "b")])
    out, place, calls = f"file://{tmp_path}/out", f"file://{tmp_path}/state", []

    def stops(batch, number):
        streams.appended(out)(batch, number)
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("stopped between the sink and the commit")

    with pytest.raises(Exception, match="stopped between"):
        streams.run_through(events(spark, tmp_path).select("event_id"), "append", place, stops)
    streams.run_through(events(spark, tmp_path).select("event_id"), "append", place, stops)
    assert calls == [0, 1, 1] and rows_of(spark.read.parquet(out).select("event_id")) == [(1,), (2,)]


def test_versions_start_from_the_same_one_again(spark, tmp_path):
    path = f"file://{tmp_path}/sums"
    add = streams.versioned(spark, path, "n long", lambda old, batch: old.union(batch).agg(F.sum("n").alias("n")))
    one = spark.createDataFrame([(1,)], "n long")
    for number in (0, 1, 1, 2):
        add(one, number)
    assert streams.versions(spark, path) == [1, 2] and spark.read.parquet(f"{path}/2").first()["n"] == 3


def test_breakers_go_on(spark, tmp_path):
    home, name = streams.shared_folder(spark), f"breakers-{tmp_path.name}"
    write(spark, tmp_path, [(1, 0, 7, "f"), (2, 1, 7, "f")])
    first = streams.breakers(attempts(spark, tmp_path), home, name=name).first()
    write(spark, tmp_path, [(3, 2, 7, "f"), (4, 3, 8, "f"), (5, 4, 8, "s")])
    then = {r["source_key"]: (r["seen"], r["failures"]) for r in streams.breakers(attempts(spark, tmp_path), home, name=name).collect()}
    assert first["failures"] == 2 and then == {7: (3, 3), 8: (2, 0)}


def plain_log(rows, opens_at, timeout, end, wait):
    """Changes (key, state, minute) of rows (event_id, minute, key, kind): each key's machine, one attempt after the other."""
    out = []
    for key in {r[2] for r in rows}:
        failures, now, last = 0, "closed", None
        for n, minute, _, kind in sorted((r for r in rows if r[2] == key and r[1] <= end - wait), key=lambda r: (r[1], r[0])):
            if now == "open" and minute - last >= timeout:
                failures, now = 0, "half_open"
                out.append((key, now, last + timeout))
            if kind == "f":
                failures, last = failures + 1, minute
                if failures >= opens_at and now != "open":
                    now = "open"
                    out.append((key, now, minute))
            else:
                failures = 0
                if now != "closed":
                    now = "closed"
                    out.append((key, now, minute))
        if now == "open" and end - wait - last >= timeout:
            out.append((key, "half_open", last + timeout))
    return sorted(out)


def logged(spark, folder, opens_at, timeout, wait, home, name, **how):
    with state.state_store(spark):
        out = streams.drained(state.breaker_log(attempts(spark, folder), opens_at, timeout * 60, f"{wait} minutes", **how), "append", home, name)
    minute = lambda t: int((t - BEGAN).total_seconds() // 60)
    return sorted((r["source_key"], r["state"], minute(r["at"])) for r in out.collect())


def test_batches_out_of_order_equal_the_order_of_time(spark, tmp_path):
    """Three files whose times overlap, within what may be late; the second run goes on with the state of the first."""
    r = random.Random(6)
    rows = [(n, n * 7 + r.randrange(-90, 90), r.randrange(1, 5), r.choice("fffs")) for n in range(120)]
    home, name = streams.shared_folder(spark), f"log-{tmp_path.name}"
    write(spark, tmp_path, rows[:40])
    write(spark, tmp_path, rows[40:80])
    logged(spark, tmp_path, 3, 60, 200, home, name)
    write(spark, tmp_path, rows[80:])
    got = logged(spark, tmp_path, 3, 60, 200, home, name)
    assert got == plain_log(rows, 3, 60, max(m for _, m, _, _ in rows), 200) and {s for _, s, _ in got} == {"open", "half_open", "closed"}


def test_a_silent_key_wakes_by_its_timer(spark, tmp_path):
    home, name = streams.shared_folder(spark), f"silent-{tmp_path.name}"
    write(spark, tmp_path, [(1, 0, 1, "f"), (2, 1, 1, "f"), (3, 10, 2, "s")])
    assert logged(spark, tmp_path, 2, 60, 0, home, name) == [(1, "open", 1)]
    write(spark, tmp_path, [(4, 61, 2, "s")])
    assert logged(spark, tmp_path, 2, 60, 0, home, name) == [(1, "half_open", 61), (1, "open", 1)]
    write(spark, tmp_path, [(5, 30, 1, "f"), (6, 62, 1, "f"), (7, 63, 1, "f"), (8, 64, 1, "s")])
    assert logged(spark, tmp_path, 2, 60, 0, home, name) == [(1, "closed", 64), (1, "half_open", 61), (1, "open", 1), (1, "open", 63)]


def test_silent_keys_are_forgotten(spark, tmp_path):
    """One failure, then a day of silence: the count begins anew."""
    home, name = streams.shared_folder(spark), f"forgets-{tmp_path.name}"
    write(spark, tmp_path, [(1, 0, 1, "f"), (2, 2000, 2, "s")])
    assert logged(spark, tmp_path, 2, 60, 0, home, name, forget_s=86_400) == []
    write(spark, tmp_path, [(3, 2001, 1, "f")])
    assert logged(spark, tmp_path, 2, 60, 0, home, name, forget_s=86_400) == []
    write(spark, tmp_path, [(4, 2002, 1, "f")])
    assert logged(spark, tmp_path, 2, 60, 0, home, name, forget_s=86_400) == [(1, "open", 2002)]


def test_rows_newer_than_the_mark(spark, tmp_path):
    home, name = streams.shared_folder(spark), f"marks-{tmp_path.name}"

    def new():
        with state.state_store(spark):
            items = events(spark, tmp_path).select(F.col("user_id").alias("source_key"), "event_id", "ts")
            return sorted(r["event_id"] for r in streams.drained(state.new_rows(items), "append", home, name).collect())

    write(spark, tmp_path, [(1, 5, 1, "a"), (2, 3, 1, "a"), (3, 9, 2, "a")])
    assert new() == [1, 2, 3]
    write(spark, tmp_path, [(4, 5, 1, "a"), (5, 6, 1, "a"), (6, 1, 3, "a"), (7, 8, 2, "a")])
    assert new() == [1, 2, 3, 5, 6]


def test_windows_drop_late_rows_and_close(spark, tmp_path):
    """Second batch: minute 20 is behind the watermark of 110 and no longer counts; minute 112 does."""
    home, name = streams.shared_folder(spark), f"slides-{tmp_path.name}"
    minute = lambda t: int((t - BEGAN).total_seconds() // 60)

    def closed():
        out = streams.drained(streams.sliding(events(spark, tmp_path), "60 minutes", "30 minutes"), "append", home, name)
        return sorted((minute(r["w"]["start"]), r["event_type"], r["n"]) for r in out.collect())

    write(spark, tmp_path, [(1, 5, 1, "a"), (2, 40, 1, "a"), (3, 120, 1, "a")])
    assert closed() == [(-30, "a", 1), (0, "a", 2), (30, "a", 1)]
    write(spark, tmp_path, [(4, 20, 1, "a"), (5, 112, 1, "a"), (6, 200, 1, "b")])
    assert closed() == [(-30, "a", 1), (0, "a", 2), (30, "a", 1), (60, "a", 1), (90, "a", 2), (120, "a", 1)]


def test_sessions_end_by_silence(spark, tmp_path):
    write(spark, tmp_path, [(1, 0, 1, "a"), (2, 20, 1, "a"), (3, 60, 1, "a"), (4, 10, 2, "a"), (5, 300, 3, "a")])
    out = streams.drained(streams.sessions(events(spark, tmp_path), "30 minutes"), "append", streams.shared_folder(spark))
    assert sorted((r["user_id"], int((r["w"]["start"] - BEGAN).total_seconds() // 60), r["n"]) for r in out.collect()) == [(1, 0, 2), (1, 60, 1), (2, 10, 1)]


class Kept:
    """A state of one key that counts how often it is used."""

    used = 0

    def __init__(self):
        self.values = []

    def exists(self):
        Kept.used += 1
        return bool(self.values)

    def get(self):
        Kept.used += 1
        return self.values if isinstance(self.values, tuple) else iter(self.values) if self.values else None

    def update(self, value):
        Kept.used += 1
        self.values = value

    put = update

    def appendValue(self, value):  # noqa: N802
        Kept.used += 1
        self.values = [*self.values, value]

    def clear(self):
        Kept.used += 1
        self.values = []


class Handle:
    def __init__(self):
        self.timers = set()

    def getListState(self, *a):  # noqa: N802
        return Kept()

    getValueState = getListState  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_the_state_of_a_breaker_is_used_a_few_times_a_batch():
    breaker, second = state.Breaker(2, 10_000_000, 1_000_000_000), 1_000_000
    breaker.init(handle := Handle())
    # 100 seconds with ten attempts each, of which those of second 40 fail; one has no number and is the last of its time.
    rows = [{"at": s * second, "event_id": n if n else None, "ok": s != 40 and (s, n) != (70, 0)} for s in range(1, 101) for n in range(10)]
    Kept.used = 0
    assert list(breaker.handleInputRows((7,), iter(rows), Now(0))) == [] and handle.timers == {1000}
    first = list(breaker.handleExpiredTimer((7,), Now(60_000), Now(1000)))
    then = list(breaker.handleInputRows((7,), iter([]), Now(200_000)))
    assert Kept.used < 15
    assert [(r["state"], r["at"]) for r in first] == [("open", datetime(1970, 1, 1, 0, 0, 40)), ("closed", datetime(1970, 1, 1, 0, 0, 41))]
    assert then == [] and not breaker.waiting.values
