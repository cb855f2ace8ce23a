"""Streams over tables of files: hourly windows, first-seen events, breakers kept as state, appends and upkeep."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Step = Callable[[DataFrame, int], None]


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. It has to be set, except where both are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.gettempdir()}/tidewire-shared"
    return folder.rstrip("/")


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 32) -> DataFrame:
    """A table of events as a stream, with ``ts`` as an event time, ``files`` new files a batch.

    The table may be one file or a folder of files: the brackets make its name a pattern, which
    a stream takes for both.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events and their sum per type and hour.

    In complete mode every hour is kept, and late events count; in append and update mode those
    later than ``late`` are dropped.
    """
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding(events: DataFrame, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """Events per type and sliding window. In append mode a window comes out once the watermark has passed its end; later rows of it are dropped and its state goes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Events per user and session: a session ends when nothing has come for ``gap``. Emitted and dropped as in sliding()."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_seen(events: DataFrame, keys: list[str], late: str | None = None) -> DataFrame:
    """The first event of each key: without expiry, or while its watermark has not passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if late else events.dropDuplicates(keys)


def run_through(stream: DataFrame, mode: str, state: str, step: Step) -> None:
    """Runs ``step`` (batch, number) over all input that is there; ``state`` is the stream's checkpoint, from which a later run goes on."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(step).start()
    query.awaitTermination()


def every(stream: DataFrame, seconds: int, state: str, step: Step):
    """The same for good: ``step`` over what has come, every so many seconds. Returns the query."""
    return stream.writeStream.option("checkpointLocation", state).trigger(processingTime=f"{seconds} seconds").foreachBatch(step).start()


def appended(path: str) -> Step:
    """Appends each batch to the table at ``path``; one that is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the tables below ``path`` (named by number, or batch=number) that were written to their end."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().rpartition("=")[2]) for f in found)


def drop_version(spark: SparkSession, path: str, number: int) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{number}")
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drained(stream: DataFrame, mode: str, folder: str, name: str | None = None) -> DataFrame:
    """Runs a stream over all input that is there and returns what it has written so far; no rows if there was no input.

    ``folder`` is shared by driver and executors: it holds the stream's checkpoint and, per
    batch, its output, so a batch that is run again replaces itself. A stream with a ``name``
    goes on where the last run with it ended; without one it is a run of its own. In complete
    mode each batch is the whole result, and the last one is returned.
    """
    spark, run = stream.sparkSession, f"{folder}/stream-{name or uuid.uuid4().hex}"
    run_through(stream, mode, f"{run}/state", appended(f"{run}/out"))
    done = versions(spark, f"{run}/out")
    if not done:
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{run}/out/batch={done[-1]}")
    return spark.read.schema(stream.schema).parquet(*[f"{run}/out/batch={n}" for n in done])


#: A breaker's state per key: events seen, failures since the last success, and the time of the last event.
BREAKER = "source_key long, seen long, failures long, last_at timestamp"


def breaker_changes(batch: DataFrame) -> DataFrame:
    """(source_key, seen, failures, healed, last_at) of a batch of attempts (source_key, event_id, success, ts).

    One row per key from two aggregates: the latest success, and the failures behind it. No key's
    attempts are gathered or sorted, however many they are.
    """
    place = F.struct("ts", "event_id")
    marks = batch.groupBy("source_key").agg(F.max(F.when(F.col("success") == 1, place)).alias("good"), F.count("*").alias("seen"), F.max("ts").alias("last_at"))
    behind = batch.join(marks.select("source_key", "good"), "source_key").filter(F.col("good").isNull() | (place > F.col("good")))
    failures = behind.groupBy("source_key").agg(F.count("*").alias("failures"))
    return marks.join(failures, "source_key", "left").select("source_key", "seen", F.coalesce("failures", F.lit(0)).alias("failures"), F.col("good").isNotNull().alias("healed"), "last_at")


def merged_breakers(state: DataFrame, changes: DataFrame, keep: int | None = None) -> DataFrame:
    """The state after a batch. With ``keep`` only that many keys stay, those heard of last; the others are closed again."""
    old = state.select("source_key", F.col("seen").alias("old_seen"), F.col("failures").alias("old_failures"), F.col("last_at").alias("old_at"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    before = F.when(F.coalesce("healed", F.lit(False)), F.lit(0)).otherwise(zero("old_failures"))
    rows = old.join(changes, "source_key", "full").select("source_key", (zero("old_seen") + zero("seen")).alias("seen"), (before + zero("failures")).alias("failures"), F.greatest("old_at", "last_at").alias("last_at"))
    return rows if keep is None else rows.orderBy(F.desc("last_at"), "source_key").limit(keep)


def breaker_state(failures: Column, last_at: Column, now: Column, opens_at: int, timeout_s: int) -> Column:
    """closed; open from ``opens_at`` failures in a row on; half_open, one attempt allowed, when ``timeout_s`` have passed since the last."""
    waited = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last_at.cast("timestamp"))
    return F.when(failures < opens_at, "closed").when(waited >= timeout_s, "half_open").otherwise("open")


def versioned(spark: SparkSession, path: str, schema: str | StructType, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Step:
    """A step that keeps a table as versions numbered by batch: ``change`` (the version before, the batch) is the next one.

    A batch that is run again starts from the same version as the first time. The version
    before stays, for those who read it; older ones are deleted.
    """

    def write(batch: DataFrame, number: int) -> None:
        done = [n for n in versions(spark, path) if n < number]
        old = spark.read.schema(schema).parquet(f"{path}/{done[-1]}") if done else spark.createDataFrame([], schema)
        change(old, batch).write.mode("overwrite").parquet(f"{path}/{number}")
        for n in done[:-1]:
            drop_version(spark, path, n)

    return write


def breakers(attempts: DataFrame, folder: str, keep: int | None = None, name: str | None = None) -> DataFrame:
    """(source_key, seen, failures, last_at) after all batches of a stream of attempts (source_key, event_id, success, ts).

    Batches are taken in the order in which the stream gives them, attempts within one in order
    of time. Each batch is aggregated and merged into the state, a small row per key, which is
    written anew under the batch's number. A stream with a ``name`` goes on where the last run
    with it ended. For state that changes by key and wakes by timer see breaker_log.
    """
    spark, run = attempts.sparkSession, f"{folder}/stream-{name or uuid.uuid4().hex}"
    run_through(attempts, "append", f"{run}/state", versioned(spark, f"{run}/versions", BREAKER, lambda old, batch: merged_breakers(old, breaker_changes(batch), keep)))
    done = versions(spark, f"{run}/versions")
    return spark.read.schema(BREAKER).parquet(f"{run}/versions/{done[-1]}") if done else spark.createDataFrame([], BREAKER)
