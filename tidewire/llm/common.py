"""Helpers shared by the corpus operators: tables, materialised steps, small column idioms."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, as a Java or Python character class and as plain text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Python workers are told where the driver has this package, whatever folder they start in."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It has to be set, except where both are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        root = f"file://{tempfile.gettempdir()}/tidewire-shared"
    return f"{root.rstrip('/')}/tidewire-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back.

    Later steps start from files that survive a lost executor, and a step that several
    consumers read is computed once.
    """
    spark = df.sparkSession
    # Spark drops the shuffle files of plans that nothing refers to any more, in either collector.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*steps: DataFrame) -> None:
    """Deletes tables that cut() wrote, once all that is made of them has been written itself."""
    for df in steps:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(df: DataFrame) -> int:
    """Shuffle width of the session, as a number of partitions for keyed steps."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", row_bytes: int = 200, most_mb: int = 48) -> DataFrame:
    """``left`` joined with a materialised ``small``: broadcast if its rows prove to fit ``most_mb``, else shuffled."""
    fits = small.count() * row_bytes <= most_mb * 1_000_000
    return left.join(F.broadcast(small) if fits else small, on, how)


def join_hot(left: DataFrame, right: DataFrame, on: str, row_bytes: int = 200, parts: int = 2000) -> DataFrame:
    """``left`` left-joined with a materialised ``right`` of one row per ``on``, with ``n``, the rows of ``left`` it has.

    A small ``right`` is broadcast. Of a larger one only keys with more than one in ``parts``
    of all rows are, at most ``parts`` of them; the others are shuffled.
    """
    if right.count() * row_bytes <= 48_000_000:
        return left.join(F.broadcast(right), on, "left")
    most = (right.agg(F.sum("n")).first()[0] or 0) // parts + 1
    hot = right.filter(F.col("n") > most)
    names = [c for c in right.columns if c != on]
    marked = left.join(F.broadcast(hot.withColumn("is_hot", F.lit(True))), on, "left")
    found = marked.filter("is_hot").drop("is_hot")
    rest = marked.filter("is_hot is null").drop("is_hot", *names)
    return found.unionByName(rest.join(right.filter(F.col("n") <= most), on, "left"))
