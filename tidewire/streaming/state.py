"""Keyed state in a stream: breakers that wake by timer, and marks up to which a source has been read."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime
from struct import Struct

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """While a query starts, its state is kept in RocksDB, which timers and several states per key need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def step(failures: int, state: str, last: int, ok: bool, at: int, opens_at: int, timeout: int) -> tuple[int, str, int, list[tuple[str, int]]]:
    """A breaker's (failures, state, last failure) after an attempt, times in microseconds, and its changes (state, time).

    It opens with the ``opens_at``-th failure in a row. When ``timeout`` has passed since the
    last failure it is half open and counts anew; a success closes it.
    """
    changes = []
    if state == "open" and at - last >= timeout:
        failures, state = 0, "half_open"
        changes.append((state, last + timeout))
    if ok:
        failures = 0
        if state != "closed":
            state = "closed"
            changes.append((state, at))
    else:
        failures, last = failures + 1, at
        if failures >= opens_at and state != "open":
            state = "open"
            changes.append((state, at))
    return failures, state, last, changes


#: An attempt that waits: its time, whether its event has no number (such come last of a time), the number, and whether it was a success. A piece of state has as many as this at most.
ATTEMPT, PIECE = Struct("<q?q?"), 50_000


class Breaker(StatefulProcessor):
    """Attempts wait until the watermark has passed them and are then taken in order of time, in whatever batch they came.

    Each use of the state is an exchange with the JVM, so what waits is packed and read and written as a whole.
    """

    def __init__(self, opens_at: int, timeout: int, forget: int):
        self.opens_at, self.timeout, self.forget = opens_at, timeout, forget

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "attempts binary")
        self.mark = handle.getValueState("mark", "failures long, state string, last long, seen long, n_waiting long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield from self._advance(key, timerValues, [(r["at"], r["event_id"] is None, r["event_id"] or 0, bool(r["ok"])) for r in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues, [], expiredTimerInfo.getExpiryTimeInMs())

    def _advance(self, key, timers, new: list[tuple[int, bool, int, bool]], expired: int | None = None) -> Iterator[Row]:
        now = timers.getCurrentWatermarkInMs() * 1000
        failures, state, last, seen, n_waiting, timer = self.mark.get() or (0, "closed", 0, 0, 0, None)
        if timer == expired:
            timer = None
        waiting = sorted([*new, *(x for piece in (self.waiting.get() if n_waiting else ()) for x in ATTEMPT.iter_unpack(piece[0]))])
        due, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        changes: list[tuple[str, int]] = []
        for at, _, _, ok in due:
            failures, state, last, more = step(failures, state, last, ok, at, self.opens_at, self.timeout)
            changes += more
            seen = at
        if state == "open" and now - last >= self.timeout:
            failures, state = 0, "half_open"
            changes.append((state, last + self.timeout))
        if later and (new or due):
            self.waiting.put([(b"".join(ATTEMPT.pack(*x) for x in later[i : i + PIECE]),) for i in range(0, len(later), PIECE)])
        elif n_waiting and not later:
            self.waiting.clear()
        forgotten = bool(seen) and not later and state != "open" and now - seen >= self.forget
        ahead = [x[0] for x in later[:1]] + ([last + self.timeout] if state == "open" else [seen + self.forget] if seen and not later else [])
        wakes = -(-min(ahead) // 1000) if ahead and not forgotten else None
        if timer != wakes:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wakes is not None:
                self.handle.registerTimer(wakes)
        if forgotten:
            self.mark.clear()
        else:
            self.mark.update((failures, state, last, seen, len(later), wakes))
        for name, at in changes:
            yield Row(source_key=key[0], state=name, at=datetime.fromtimestamp(at // 1_000_000, UTC).replace(tzinfo=None, microsecond=at % 1_000_000))

    def close(self) -> None:
        pass


def breaker_log(attempts: DataFrame, opens_at: int = 5, timeout_s: int = 60, late: str = "0 seconds", forget_s: int = 30 * 86_400) -> DataFrame:
    """(source_key, state, at): every change of every breaker, of a stream of attempts (source_key, event_id, success, ts).

    Attempts are taken in order of (ts, event_id), across batches too; those that come later
    than ``late`` behind the latest are dropped. An open breaker becomes half open by a timer,
    with no attempt needed. Keys that are not open are forgotten ``forget_s`` after their last
    attempt. Run the stream within state_store().
    """
    micros = lambda s: s * 1_000_000
    rows = attempts.filter("source_key is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select("source_key", "event_id", (F.col("success") == 1).alias("ok"), "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("source_key").transformWithState(Breaker(opens_at, micros(timeout_s), micros(forget_s)), f"source_key {dict(attempts.dtypes)['source_key']}, state string, at timestamp_ntz", "Append", "EventTime")


class NewRows(StatefulProcessor):
    """Rows of a source that are newer than any of an earlier batch."""

    def init(self, handle) -> None:
        self.mark = handle.getValueState("mark", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark = self.mark.get()[0] if self.mark.exists() else None
        top = mark
        for r in rows:
            if mark is None or r["at"] > mark:
                top = r["at"] if top is None else max(top, r["at"])
                yield Row(source_key=key[0], event_id=r["event_id"], at=datetime.fromtimestamp(r["at"] // 1_000_000, UTC).replace(tzinfo=None, microsecond=r["at"] % 1_000_000))
        if top is not None:
            self.mark.update((top,))

    def close(self) -> None:
        pass


def new_rows(items: DataFrame, keep: str | None = None) -> DataFrame:
    """(source_key, event_id, at) of a stream of items (source_key, event_id, ts): those newer than their source's mark, the latest time of earlier batches.

    Items of one batch do not shadow each other. Run the stream within state_store().
    """
    rows = items.filter("source_key is not null and ts is not null").select("source_key", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("source_key").transformWithState(NewRows(), f"source_key {dict(items.dtypes)['source_key']}, event_id long, at timestamp_ntz", "Append", "None")
