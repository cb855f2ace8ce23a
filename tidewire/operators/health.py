"""Attempt logs: scores of methods, failure runs, spacing, breakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(part: Column, whole: Column, digits: int) -> Column:
    """The quotient of two whole numbers, neither negative, rounded half up; the rounding is done on whole numbers, so no order of addition can change it."""
    long = lambda c: c.cast("decimal(38,0)")
    n = F.call_function("div", long(part) * (2 * 10**digits) + long(whole), long(whole) * 2)
    return n.cast("double") / 10**digits


def method_scores(attempts: DataFrame, *keys: str, slowest_ms: float = 60_000.0) -> DataFrame:
    """Attempts, success rate, mean duration and score (0.6 of success, 0.4 of speed) per method within ``keys``.

    Durations count in whole microseconds; attempts without one have no share in the mean and in speed.
    """
    slowest, long = round(slowest_ms * 1000), lambda c: c.cast("decimal(38,0)")
    micros = F.round(F.col("duration_ms") * 1000).cast("bigint")
    summed = attempts.groupBy(*keys, "method").agg(F.count("*").alias("n"), F.sum("success").cast("bigint").alias("good"), F.count(micros).alias("timed"), F.coalesce(F.sum(micros), F.lit(0)).alias("micros"))
    n, good, timed, spent = (long(F.col(c)) for c in ("n", "good", "timed", "micros"))
    # 0.6 * good / n + 0.4 * (1 - spent / (timed * slowest)), both over one denominator.
    limit = timed * long(F.lit(slowest))
    both = F.when(F.col("timed") > 0, rounded(good * limit * 6 + n * F.greatest(limit - spent, long(F.lit(0))) * 4, n * limit * 10, 3)).otherwise(rounded(good * 6, n * 10, 3))
    return summed.select(*keys, "method", "n", rounded(good, n, 4).alias("success_rate"), F.when(F.col("timed") > 0, rounded(spent, timed * 1000, 2)).alias("mean_ms"), both.alias("score"))


def best_methods(scores: DataFrame, *keys: str) -> DataFrame:
    """The best method per key; of equal scores the first in the alphabet."""
    return scores.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("method").alias("m"))).alias("best")).select(*keys, F.col("best.m").alias("method"), (-F.col("best.s")).alias("score"))


def _in_order(key: str) -> Window:
    return Window.partitionBy(key).orderBy("ts", "event_id")


def failure_runs(attempts: DataFrame, key: str = "source_key") -> DataFrame:
    """Each attempt with the number of failures in a row up to it."""
    running = _in_order(key).rowsBetween(Window.unboundedPreceding, 0)
    island = attempts.withColumn("island", F.sum("success").over(running))
    return island.withColumn("failures", F.sum(1 - F.col("success")).over(Window.partitionBy(key, "island").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))).drop("island")


def breakers(attempts: DataFrame, key: str = "source_key", opens_at: int = 3) -> DataFrame:
    """Per key the failures since its last success, and whether its breaker is open."""
    marks = attempts.groupBy(key).agg(F.max(F.when(F.col("success") == 1, F.struct("ts", "event_id"))).alias("good"))
    since = attempts.join(marks, key).filter(F.col("good").isNull() | (F.struct("ts", "event_id") > F.col("good")))
    counted = since.groupBy(key).agg(F.count("*").alias("failures"))
    return marks.join(counted, key, "left").select(key, F.coalesce("failures", F.lit(0)).alias("failures"), (F.coalesce("failures", F.lit(0)) >= opens_at).cast("int").alias("is_open"))


def last_success(attempts: DataFrame, key: str = "source_key") -> DataFrame:
    good = attempts.filter(F.col("success") == 1)
    return good.groupBy(key).agg(F.max_by(F.struct("method", "ts"), F.struct("ts", "event_id")).alias("last")).select(key, F.col("last.method").alias("method"), F.col("last.ts").alias("last_at"))


def running_latency(attempts: DataFrame, key: str = "source_key") -> DataFrame:
    """Mean duration up to each attempt, from whole microseconds, so that the order of addition doesn't matter."""
    w = _in_order(key).rowsBetween(Window.unboundedPreceding, 0)
    micros = F.round(F.col("duration_ms") * 1000).cast("bigint")
    return attempts.select(key, "event_id", F.floor(F.sum(micros).over(w) / F.count("*").over(w)).cast("bigint").alias("mean_us"))


def spacing(attempts: DataFrame, least_s: float, key: str = "source_key") -> DataFrame:
    """Attempts that follow the one before within ``least_s`` seconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = micros(F.col("ts")) - micros(F.lag("ts").over(_in_order(key)))
    return attempts.withColumn("gap_us", gap).filter(F.col("gap_us") < least_s * 1_000_000).select(key, "event_id", "gap_us")


def reliability(attempts: DataFrame, key: str = "source_key", kinds: int = 4) -> DataFrame:
    """Success rate, less a penalty for failures in a row, plus a bonus for methods that work; 0 to 1."""
    runs = breakers(attempts, key).select(key, "failures")
    base = attempts.groupBy(key).agg((F.sum("success").cast("double") / F.count("*")).alias("rate"), F.count_distinct(F.when(F.col("success") == 1, F.col("method"))).alias("working"))
    score = F.col("rate") - F.least(F.col("failures") * 0.1, F.lit(0.5)) + F.col("working") / float(kinds) * 0.1
    return base.join(runs, key).select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("reliability"))


def ladder(count: Column, warn: int, bad: int) -> Column:
    return F.when(count > bad, "unhealthy").when(count > warn, "degraded").otherwise("healthy")


def choose(candidates: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first valid candidate of each key in order: the cascade over results that are at hand."""
    return candidates.filter("valid").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def learned_first(learned: Column, by_priority: list[str]) -> Column:
    """The methods in order, the learned one moved to the front."""
    order = F.array(*map(F.lit, by_priority))
    return F.when(F.array_contains(order, learned), F.concat(F.array(learned), F.array_remove(order, learned))).otherwise(order)
