"""Incremental writes as rewrites of tables: insert if absent, keep latest, marks, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_absent(new: DataFrame, existing: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows to append: of each new key that ``existing`` lacks the first in order."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*[c for c in new.columns if c != key]), F.struct(*order)).alias("_row")).select(key, "_row.*")
    return first.join(existing.select(key), key, "left_anti")


def keep_latest(old: DataFrame, new: DataFrame, key: str, *version: Column) -> DataFrame:
    """Both tables with the latest row of each key. One aggregate, no sort."""
    rows = old.unionByName(new, allowMissingColumns=True)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*version)).alias("_row")).select(key, "_row.*")


def above_mark(rows: DataFrame, marks: DataFrame, key: str, ts: str, overlap: str | None = None) -> DataFrame:
    """Rows later than their key's mark (``mark``), or later than it less ``overlap``; all rows of keys without one."""
    mark = F.col("mark") - F.expr(f"INTERVAL {overlap}") if overlap else F.col("mark")
    return rows.join(marks.select(key, "mark"), key, "left").filter(F.col("mark").isNull() | (F.col(ts) > mark)).drop("mark")


def marks_of(rows: DataFrame, key: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max(ts).alias("mark"))


def seen_delta(batch: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """New keys of a batch with how often the batch has them; those already seen are left out."""
    return batch.groupBy(key).agg(F.count("*").alias("view_count")).join(seen.select(key), key, "left_anti")


def retained(rows: DataFrame, ts: str, as_of: str, days: int) -> DataFrame:
    return rows.filter(F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def enrich(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Values of ``updates`` where they are not null, else the old ones."""
    named = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = rows.join(named, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def split_by(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and rejected ones with their reason."""
    tagged = rows.withColumn("reason", reason)
    return tagged.filter("reason is null").drop("reason"), tagged.filter("reason is not null")


def recode(value: Column, mapping: dict[str, str]) -> Column:
    """The mapped value, or the value itself."""
    pairs = [x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


def default_text(value: Column, default: Column) -> Column:
    """A default where text is null or blank."""
    return F.coalesce(F.when(F.trim(value) != "", value), default)


def upserted(old: DataFrame, new: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """``old`` with the values of ``new`` where both have the key, and the rows that are new; columns that new rows lack take a default."""
    named = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key], F.lit(True).alias("_there"))
    joined = old.withColumn("_known", F.lit(True)).join(named, key, "full")

    def value(c: str) -> Column:
        if c in new.columns:
            return F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c))
        return F.when(F.col("_known"), F.col(c)).otherwise(defaults.get(c, F.lit(None)))

    return joined.select(key, *[value(c).alias(c) for c in old.columns if c != key])


def without_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of all other keys: a reset."""
    return rows.join(keys.select(key), key, "left_anti")


def moved(items: DataFrame, steps: list[tuple[str, str, Column]]) -> DataFrame:
    """Items whose status is moved on by each step (from, to, condition) in turn."""
    for old, new, condition in steps:
        ready = (F.col("status") == old) & F.coalesce(condition, F.lit(False))
        items = items.withColumn("status", F.when(ready, F.lit(new)).otherwise(F.col("status")))
    return items
