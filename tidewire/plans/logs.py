"""Attempt logs, incremental writes and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.operators import health, ingest
from tidewire.operators import relational as rel
from tidewire.plans import ATTEMPTS, CARDS, query
from tidewire.sources.roles import attempts, cards, table
from tidewire.streaming import streams

RUN_SQL = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
ISLANDS = f"islands AS (SELECT *, sum(success) OVER (PARTITION BY source_key ORDER BY ts, event_id {RUN_SQL}) AS island FROM attempts)"


@query(f"SELECT source_key, event_id, (sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}))::bigint AS failures FROM islands", ATTEMPTS, ISLANDS)
def win_failure_islands(spark, sf):
    return health.failure_runs(attempts(spark, sf)).select("source_key", "event_id", "failures")


@query(f"""SELECT source_key, failures, CASE WHEN failures >= 3 THEN 1 ELSE 0 END AS is_open FROM (SELECT source_key, arg_max(failures, (ts, event_id)) AS failures FROM
 (SELECT source_key, ts, event_id, (sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}))::bigint AS failures FROM islands) GROUP BY 1)""", ATTEMPTS, ISLANDS)
def health_breakers(spark, sf):
    return health.breakers(attempts(spark, sf))


@query("SELECT source_key, arg_max(method, (ts, event_id)) AS method, max(ts) AS last_at FROM attempts WHERE success = 1 GROUP BY 1", ATTEMPTS)
def win_last_success_method(spark, sf):
    return health.last_success(attempts(spark, sf))


@query(f"SELECT source_key, event_id, floor(sum(round(duration_ms * 1000)::bigint) OVER (PARTITION BY source_key ORDER BY ts, event_id {RUN_SQL})::double / count(*) OVER (PARTITION BY source_key ORDER BY ts, event_id {RUN_SQL}))::bigint AS mean_us FROM attempts", ATTEMPTS)
def win_running_latency(spark, sf):
    return health.running_latency(attempts(spark, sf))


@query("SELECT * FROM (SELECT source_key, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source_key ORDER BY ts, event_id)) AS gap_us FROM attempts) WHERE gap_us < 3600000000", ATTEMPTS)
def win_spacing_violations(spark, sf):
    return health.spacing(attempts(spark, sf), 3600)


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn <= 3")
def win_first_per_group(spark, sf):
    return rel.first_per(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), 3, ["source"], F.desc("n_chars"), F.col("doc_id")).select("doc_id", "source")


# Durations are summed in whole microseconds and quotients are rounded half up as whole numbers, so that no order of addition moves a score over a rounding boundary.
MICROS_SQL = "sum(round(duration_ms * 1000)::bigint)"
SCORE_SQL = f"count(*) AS n, ((20000 * sum(success) + count(*)) // (2 * count(*)))::double / 10000 AS success_rate, ((200 * {MICROS_SQL} + 1000 * count(*)) // (2000 * count(*)))::double / 100 AS mean_ms, ((2000 * (6 * sum(success) * 60000000 + 4 * greatest(0, 60000000 * count(*) - {MICROS_SQL})) + 600000000 * count(*)) // (1200000000 * count(*)))::double / 1000 AS score"


@query(f"SELECT source_key, method, {SCORE_SQL} FROM attempts GROUP BY 1, 2", ATTEMPTS)
def health_method_scores(spark, sf):
    return health.method_scores(attempts(spark, sf), "source_key")


@query(f"SELECT source_key, arg_min(method, (-score, method)) AS method, max(score) AS score FROM (SELECT source_key, method, {SCORE_SQL} FROM attempts GROUP BY 1, 2) GROUP BY 1", ATTEMPTS)
def health_best_method(spark, sf):
    return health.best_methods(health_method_scores(spark, sf), "source_key")


@query(f"SELECT hour, arg_min(method, (-score, method)) AS method, max(score) AS score FROM (SELECT hour(ts)::int AS hour, method, {SCORE_SQL} FROM attempts GROUP BY 1, 2) GROUP BY 1", ATTEMPTS)
def health_by_hour(spark, sf):
    return health.best_methods(health.method_scores(attempts(spark, sf).withColumn("hour", F.hour("ts")), "hour"), "hour")


@query(f"""SELECT a.source_key, round(greatest(0, least(1, rate - least(failures * 0.1::double, 0.5::double) + working / 4.0::double * 0.1::double)), 4)::double AS reliability FROM
 (SELECT source_key, sum(success)::double / count(*) AS rate, count(DISTINCT method) FILTER (success = 1) AS working FROM attempts GROUP BY 1) a JOIN
 (SELECT source_key, arg_max(failures, (ts, event_id)) AS failures FROM (SELECT source_key, ts, event_id, sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}) AS failures FROM islands) GROUP BY 1) b ON a.source_key = b.source_key""", ATTEMPTS, ISLANDS)
def health_reliability(spark, sf):
    return health.reliability(attempts(spark, sf))


@query(f"SELECT method, score, row_number() OVER (ORDER BY score DESC, method) AS rank FROM (SELECT method, {SCORE_SQL} FROM attempts GROUP BY 1)", ATTEMPTS)
def health_method_order(spark, sf):
    scores = health.method_scores(attempts(spark, sf))
    return rel.with_rank(scores, "rank", F.desc("score"), F.col("method")).select("method", "score", "rank")


@query("SELECT source_key, arg_min(event_id, (p, event_id)) AS event_id, arg_min(method, (p, event_id)) AS method FROM (SELECT *, CASE method WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS p FROM attempts WHERE success = 1 AND duration_ms > 100) GROUP BY 1", ATTEMPTS)
def health_cascade_choice(spark, sf):
    """Per source the first valid result by the methods' priority."""
    priority = F.when(F.col("method") == "purchase", 0).when(F.col("method") == "signup", 1).when(F.col("method") == "click", 2).otherwise(3)
    tried = attempts(spark, sf).withColumn("p", priority).withColumn("valid", (F.col("success") == 1) & (F.col("duration_ms") > 100))
    return health.choose(tried, "source_key", F.col("p"), F.col("event_id")).select("source_key", "event_id", "method")


@query("SELECT method, n_open, CASE WHEN n_open > 10 THEN 'unhealthy' WHEN n_open > 3 THEN 'degraded' ELSE 'healthy' END AS status FROM (SELECT method, count(DISTINCT source_key) FILTER (success = 0) AS n_open FROM attempts GROUP BY 1)", ATTEMPTS)
def health_extractors(spark, sf):
    failing = attempts(spark, sf).groupBy("method").agg(F.count_distinct(F.when(F.col("success") == 0, F.col("source_key"))).alias("n_open"))
    return failing.withColumn("status", health.ladder(F.col("n_open"), 3, 10))


@query("SELECT source_key, count(*) AS n, count(*) FILTER (success = 0) AS errors, max(ts) FILTER (success = 1) AS last_at FROM attempts GROUP BY 1 HAVING count(*) FILTER (success = 0)::double / count(*) > 0.35 OR max(ts) FILTER (success = 1) IS NULL OR max(ts) FILTER (success = 1) < TIMESTAMP '2024-01-29' ORDER BY errors DESC, source_key LIMIT 50", ATTEMPTS)
def rel_problem_sources(spark, sf):
    per = attempts(spark, sf).groupBy("source_key").agg(F.count("*").alias("n"), F.count_if(F.col("success") == 0).alias("errors"), F.max(F.when(F.col("success") == 1, F.col("ts"))).alias("last_at"))
    bad = (F.try_divide("errors", "n") > 0.35) | F.col("last_at").isNull() | (F.col("last_at") < F.expr("timestamp_ntz'2024-01-29'"))
    return rel.top(per.filter(bad), 50, F.desc("errors"), F.col("source_key"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1")
def events_by_type(spark, sf):
    return rel.counts_by(table(spark, sf, "events").filter("ts >= timestamp_ntz'2024-01-30'"), "event_type")


@query("SELECT method, count(*) AS n FROM attempts WHERE success = 0 GROUP BY 1 ORDER BY n DESC, method LIMIT 10", ATTEMPTS)
def rel_error_histogram(spark, sf):
    return rel.top(rel.counts_by(attempts(spark, sf).filter("success = 0"), "method"), 10, F.desc("n"), F.col("method"))


@query("SELECT user_id, count(*) AS view_count FROM events WHERE ts >= TIMESTAMP '2024-01-01 06:00:00' AND user_id NOT IN (SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-01 06:00:00') GROUP BY 1")
def ing_delta_new(spark, sf):
    """Users of a later load that the first hours' load did not have."""
    e = table(spark, sf, "events")
    first = F.col("ts") < F.expr("timestamp_ntz'2024-01-01 06:00:00'")
    return ingest.seen_delta(e.filter(~first), e.filter(first).select("user_id").distinct(), "user_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def ing_keep_latest(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return ingest.keep_latest(e.filter("ts < timestamp_ntz'2024-01-15'"), e.filter("ts >= timestamp_ntz'2024-01-15'"), "user_id", F.col("ts"), F.col("event_id")).select(e.columns)


@query("SELECT doc_id, source, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ing_insert_absent(spark, sf):
    """Documents that have no label row yet."""
    d, labels = table(spark, sf, "documents").select("doc_id", "source", "lang"), table(spark, sf, "labels")
    return ingest.insert_absent(d, labels.select("doc_id").distinct(), "doc_id", F.col("source"), F.col("lang"))


def _mark_sql(minus: str) -> str:
    return f"SELECT event_id, e.user_id FROM events e LEFT JOIN (SELECT user_id, max(ts) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) m ON e.user_id = m.user_id WHERE mark IS NULL OR ts > mark{minus}"


def _above(spark, sf, overlap=None):
    """Of all events those above the mark that an earlier load left for their user."""
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    marks = ingest.marks_of(e.filter("ts < timestamp_ntz'2024-01-20'"), "user_id", "ts")
    return ingest.above_mark(e, marks, "user_id", "ts", overlap).select("event_id", "user_id")


@query(_mark_sql(""))
def ing_highwater(spark, sf):
    return _above(spark, sf)


@query(_mark_sql(" - INTERVAL 1 HOUR"))
def ing_highwater_overlap(spark, sf):
    return _above(spark, sf, "1 HOUR")


@query("SELECT id, CASE category WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE category END AS category, created_at FROM cards ORDER BY created_at DESC, id DESC LIMIT 100", CARDS)
def ing_sync_recode(spark, sf):
    return rel.newest(cards(spark, sf), 100).select("id", ingest.recode(F.col("category"), {"O": "open", "F": "final"}).alias("category"), "created_at")


@query("SELECT id FROM cards WHERE created_at >= TIMESTAMP '2001-08-01' - INTERVAL 90 DAY", CARDS)
def ing_retention(spark, sf):
    return ingest.retained(cards(spark, sf), "created_at", "2001-08-01", 90).select("id")


@query("SELECT id, coalesce(upper(c_mktsegment), category) AS category, coalesce(quality, CASE WHEN is_press = 1 THEN 0.1 ELSE 0.5 END)::double AS quality FROM cards LEFT JOIN customer ON source_id = c_custkey AND c_acctbal > 0", CARDS)
def ing_enrich(spark, sf):
    c = cards(spark, sf)
    updates = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("source_id"), F.upper("c_mktsegment").alias("category"))
    return ingest.enrich(c, updates, "source_id", ["category"]).select("id", "category", F.coalesce("quality", F.when(F.col("is_press") == 1, 0.1).otherwise(0.5)).alias("quality"))


HOUR_SQL = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query(HOUR_SQL)
def rel_hourly(spark, sf):
    per = table(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type")
    return per.agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(HOUR_SQL)
def stream_hourly(spark, sf):
    out = streams.drained(streams.hourly(streams.event_stream(spark, sf)), "complete", streams.shared_folder(spark))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 2).alias("total"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf):
    seen = streams.first_seen(streams.event_stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"])
    return streams.drained(seen, "append", streams.shared_folder(spark)).select("user_id", "event_type")
