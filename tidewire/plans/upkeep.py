"""Streams that append, keep state and tidy up."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.operators import clusters, ingest
from tidewire.operators import relational as rel
from tidewire.operators.tables import KeyedTable
from tidewire.plans import ATTEMPTS, ORACLES, TEXTS, query
from tidewire.plans.content import SIG_WORDS, TITLE
from tidewire.plans.desk import masters
from tidewire.plans.logs import ISLANDS, RUN_SQL
from tidewire.sources.roles import cards, table, texts
from tidewire.streaming import state, streams


def _run(spark) -> str:
    return f"{streams.shared_folder(spark)}/run-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, user_id, coalesce(json_extract_string(props, '$.k')::bigint, -1) AS k FROM events")
def stream_append_events(spark, sf):
    """Tracked events appended to their table as they come; a batch that is run again replaces what it wrote."""
    run = _run(spark)
    tracked = streams.event_stream(spark, sf).select("event_id", "event_type", "user_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(-1).cast("bigint")).alias("k"))
    streams.run_through(tracked, "append", f"{run}/state", streams.appended(f"{run}/out"))
    return spark.read.parquet(f"{run}/out").drop("batch")


@query("SELECT source_key, method, count(*) AS n, sum(success)::bigint AS successes FROM attempts GROUP BY 1, 2", ATTEMPTS)
def stream_append_attempts(spark, sf):
    """The log of attempts as a table that each batch is appended to, counted."""
    run = _run(spark)
    log = streams.event_stream(spark, sf).select(F.col("user_id").alias("source_key"), F.col("event_type").alias("method"), F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), 0).otherwise(1).alias("success"), "ts")
    streams.run_through(log, "append", f"{run}/state", streams.appended(f"{run}/out"))
    return spark.read.parquet(f"{run}/out").groupBy("source_key", "method").agg(F.count("*").alias("n"), F.sum("success").alias("successes"))


@query(f"""SELECT source_key, CASE WHEN failures < 2 THEN 'closed' WHEN epoch(TIMESTAMP '2024-01-31') - epoch(date_trunc('second', last_at)) >= 21600 THEN 'half_open' ELSE 'open' END AS state FROM (SELECT source_key, arg_max(failures, (ts, event_id)) AS failures, max(ts) AS last_at FROM
 (SELECT source_key, ts, event_id, (sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}))::bigint AS failures FROM islands) GROUP BY 1)""", ATTEMPTS, ISLANDS)
def stream_breaker_states(spark, sf):
    """Breakers over the stream: open from two failures in a row, half open when six hours have passed since."""
    log = streams.event_stream(spark, sf).select(F.col("user_id").alias("source_key"), "event_id", F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), 0).otherwise(1).alias("success"), "ts")
    state = streams.breakers(log, streams.shared_folder(spark))
    return state.select("source_key", streams.breaker_state(F.col("failures"), F.col("last_at"), F.lit("2024-01-31 00:00:00"), 2, 21600).alias("state"))


SIGNATURE = f"array_to_string(list_sort(list_slice(list_sort(list_transform(list_distinct({SIG_WORDS.format(TITLE)}), lambda w: (-length(w), w))), 1, 6).list_transform(lambda x: x[2])), '|')"


@query(f"""WITH {TEXTS}, cards AS (SELECT id, {SIGNATURE} AS signature, TIMESTAMP '2024-01-01' + to_days((id % 30)::int) AS created_at FROM texts), kept AS (SELECT * FROM cards WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 21 DAY),
 due AS (SELECT * FROM kept WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR)
 SELECT id, CASE WHEN id IN (SELECT id FROM due) AND signature <> '' AND signature IN (SELECT signature FROM due GROUP BY 1 HAVING count(*) >= 2) THEN left(md5(signature), 12) END AS cluster_id FROM kept""")
def stream_upkeep(spark, sf):
    """The periodic job as a batch of a stream: when events have come, recent cards are clustered and old ones go."""
    run, as_of = _run(spark), "2024-01-31 00:00:00"
    created = F.expr("timestamp_ntz'2024-01-01'") + F.make_dt_interval(F.col("id") % 30)
    cards = texts(spark, sf).select("id", "title", created.alias("created_at"), F.lit(None).cast("string").alias("cluster_id"))
    # The cards as they are when the stream begins: the version before its first batch.
    cards.write.parquet(f"{run}/cards/-1")

    def tidy(old, batch):
        if batch.isEmpty():
            return old
        found = clusters.by_signature(clusters.unclustered(old, as_of, hours=240))
        return ingest.retained(clusters.written_back(old, found), "created_at", as_of, 21)

    streams.run_through(streams.event_stream(spark, sf), "append", f"{run}/state", streams.versioned(spark, f"{run}/cards", cards.schema, tidy))
    last = streams.versions(spark, f"{run}/cards")[-1]
    return spark.read.parquet(f"{run}/cards/{last}").select("id", "cluster_id")


@query("SELECT hours, event_type, count(*) AS n FROM (SELECT *, unnest([1, 24, 168, 720]) AS hours FROM events) WHERE ts >= TIMESTAMP '2024-01-31' - to_hours(hours) GROUP BY 1, 2")
def rel_relative_windows(spark, sf):
    """Events of the last hour, day, week and month, as of one time."""
    e = table(spark, sf, "events").select("event_type", "ts", F.explode(F.array(*map(F.lit, (1, 24, 168, 720)))).alias("hours"))
    recent = F.col("ts") >= F.expr("timestamp_ntz'2024-01-31'") - F.make_dt_interval(F.lit(0), F.col("hours"))
    return rel.counts_by(e.filter(recent), "hours", "event_type")


@query("SELECT url, min(event_id) AS event_id FROM (SELECT concat(event_type, user_id::varchar) AS url, event_id FROM events) GROUP BY 1")
def ing_raw_rows(spark, sf):
    """Raw rows appended in two loads; a later step keeps the first of each URL."""
    run = _run(spark)
    rows = table(spark, sf, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("url"), "event_id", "ts")
    early = F.col("ts") < F.expr("timestamp_ntz'2024-01-15'")
    rows.filter(early).write.mode("append").parquet(f"{run}/raw")
    rows.filter(~early).write.mode("append").parquet(f"{run}/raw")
    return spark.read.parquet(f"{run}/raw").groupBy("url").agg(F.min("event_id").alias("event_id"))


LAST = "wm AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE AS w FROM events)"


@query("SELECT s AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, unnest(range(date_trunc('hour', ts) - INTERVAL 5 HOUR, date_trunc('hour', ts) + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS s FROM events), wm WHERE s + INTERVAL 6 HOUR <= w GROUP BY 1, 2", LAST)
def stream_sliding(spark, sf):
    """Windows of six hours, one each hour, as the watermark closes them; those still open at the end do not come out."""
    out = streams.drained(streams.sliding(streams.event_stream(spark, sf), "6 hours", "1 hour"), "append", streams.shared_folder(spark))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
 (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events)), wm GROUP BY user_id, session, w HAVING max(ts) + INTERVAL 4 HOUR <= w""", LAST)
def stream_sessions(spark, sf):
    """Sessions of users, ended by four hours without an event."""
    out = streams.drained(streams.sessions(streams.event_stream(spark, sf), "4 hours"), "append", streams.shared_folder(spark))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n", F.round("total", 2).alias("total"))


# The machine goes through each key's attempts in order; an open breaker whose time is up by the next attempt, or by the end, is half open first.
@query("""SELECT source_key, unnest(names) AS state, unnest(times) AS at FROM (SELECT source_key, CASE WHEN d.state = 'open' AND d.last + INTERVAL 6 HOUR <= w THEN list_append(d.names, 'half_open') ELSE d.names END AS names, CASE WHEN d.state = 'open' AND d.last + INTERVAL 6 HOUR <= w THEN list_append(d.times, d.last + INTERVAL 6 HOUR) ELSE d.times END AS times FROM
 (SELECT source_key, list_reduce([{'ok': true, 'ts': TIMESTAMP '2000-01-01', 'failures': 0, 'state': 'closed', 'last': TIMESTAMP '2000-01-01', 'names': []::varchar[], 'times': []::timestamp[]}] || list({'ok': success = 1, 'ts': ts, 'failures': 0, 'state': 'closed', 'last': ts, 'names': []::varchar[], 'times': []::timestamp[]} ORDER BY ts, event_id), lambda a, e:
  {'ok': e.ok, 'ts': e.ts, 'failures': CASE WHEN e.ok THEN 0 WHEN a.state = 'open' AND e.ts - a.last >= INTERVAL 6 HOUR THEN 1 ELSE a.failures + 1 END,
  'state': CASE WHEN e.ok THEN 'closed' WHEN a.state = 'open' THEN CASE WHEN e.ts - a.last >= INTERVAL 6 HOUR THEN 'half_open' ELSE 'open' END WHEN a.failures + 1 >= 2 THEN 'open' ELSE a.state END, 'last': CASE WHEN e.ok THEN a.last ELSE e.ts END,
  'names': a.names || CASE WHEN a.state = 'open' AND e.ts - a.last >= INTERVAL 6 HOUR THEN ['half_open'] ELSE [] END || CASE WHEN e.ok AND a.state <> 'closed' THEN ['closed'] WHEN NOT e.ok AND a.state <> 'open' AND a.failures + 1 >= 2 THEN ['open'] ELSE [] END,
  'times': a.times || CASE WHEN a.state = 'open' AND e.ts - a.last >= INTERVAL 6 HOUR THEN [a.last + INTERVAL 6 HOUR] ELSE [] END || CASE WHEN (e.ok AND a.state <> 'closed') OR (NOT e.ok AND a.state <> 'open' AND a.failures + 1 >= 2) THEN [e.ts] ELSE [] END}) AS d FROM attempts, wm WHERE ts <= w GROUP BY source_key), wm)""", ATTEMPTS, LAST)
def stream_breaker_log(spark, sf):
    """Every change of every breaker, open from two failures in a row, half open six hours later by a timer."""
    log = streams.event_stream(spark, sf).select(F.col("user_id").alias("source_key"), "event_id", F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), 0).otherwise(1).alias("success"), "ts")
    with state.state_store(spark):
        return streams.drained(state.breaker_log(log, 2, 21_600, "10 minutes"), "append", streams.shared_folder(spark))


@query("SELECT user_id AS source_key, event_id, ts AS at FROM events")
def stream_new_rows(spark, sf):
    """Rows newer than their source's mark, and none the second time the stream looks."""
    rows = streams.event_stream(spark, sf).select(F.col("user_id").alias("source_key"), "event_id", "ts")
    name = uuid.uuid4().hex
    with state.state_store(spark):
        for _ in range(2):
            out = streams.drained(state.new_rows(rows), "append", streams.shared_folder(spark), name)
    return out


# ---- tables by key


def _keyed(rows, key: str) -> KeyedTable:
    return KeyedTable(rows.sparkSession, f"{_run(rows.sparkSession)}/table", rows.schema, key, buckets=32)


@query(ORACLES["ing_keep_latest"])
def ing_bucket_latest(spark, sf):
    """Three loads of events into a table by user; each writes the folders of its users only."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    kept = _keyed(e, "user_id")
    day = lambda d: F.expr(f"timestamp_ntz'2024-01-{d}'")
    for part in (F.col("ts") < day("15"), (F.col("ts") >= day("15")) & (F.col("ts") < day("29")), F.col("ts") >= day("29")):
        kept.keep_latest(e.filter(part), F.col("ts"), F.col("event_id"))
    return kept.read()


@query(ORACLES["ing_masters"])
def ing_bucket_masters(spark, sf):
    """Masters of the clusters of a first load; those that later cards come to are made anew and replace theirs."""
    c = cards(spark, sf)
    early = F.col("created_at") < F.lit("1995-01-01").cast("timestamp_ntz")
    first = masters(c.filter(early))
    kept = _keyed(first, "cluster_id")
    kept.upsert(first)
    kept.upsert(masters(c.join(c.filter(~early).select("cluster_id").distinct(), "cluster_id", "left_semi")))
    return kept.read()


@query("SELECT vec_id, CASE WHEN label >= 3 THEN label + 100 ELSE label END AS label, len(embedding)::bigint AS size FROM embeddings")
def ing_bucket_vectors(spark, sf):
    """Vectors with their labels, upserted where they come again."""
    v = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    kept = _keyed(v, "vec_id")
    kept.insert_absent(v.filter("label < 5"), F.col("label"))
    kept.upsert(v.filter("label >= 3").withColumn("label", (F.col("label") + 100).cast("int")))
    return kept.read().select("vec_id", "label", F.size("embedding").cast("bigint").alias("size"))


@query(ORACLES["ing_keep_latest"])
def stream_bucket_latest(spark, sf):
    """The latest event of each user as a stream's sink: a batch that is run again is merged once."""
    e = streams.event_stream(spark, sf).select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")
    kept = KeyedTable(spark, f"{(run := _run(spark))}/table", e.schema, "user_id", buckets=32)
    streams.run_through(e, "append", f"{run}/state", lambda batch, number: kept.keep_latest(batch, F.col("ts"), F.col("event_id"), token=str(number)))
    return kept.read()
