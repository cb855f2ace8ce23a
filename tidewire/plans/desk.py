"""Publishing, health upkeep, validation and the remaining reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import labels, text, times, urls
from tidewire.operators import facts, health, ingest, scoring, search, vectors
from tidewire.operators import relational as rel
from tidewire.plans import ATTEMPTS, CARDS, LOCATIONS, ORACLES, TEXTS, query
from tidewire.plans.content import ARTICLES, COS, FACTS, FAMILIES, REJECT_SQL, SENTENCES, _articles, bm25_sql, txt_search_index, vec_index_exact
from tidewire.plans.logs import ISLANDS, RUN_SQL
from tidewire.sources import markup
from tidewire.sources.roles import attempts, cards, locations, table, texts
from tidewire.streaming import streams

# ---- writes


@query("SELECT id, coalesce(location_id, 0)::int AS location_id, coalesce(category, 'local') AS category, CASE WHEN coalesce(quality, 0) = 0 THEN 0.5::double ELSE quality END AS quality, 1 AS synced FROM cards", CARDS)
def ing_publish(spark, sf):
    """Defaults of published cards; a quality of 0 counts as missing."""
    shown = F.when(F.coalesce("quality", F.lit(0.0)) == 0, 0.5).otherwise(F.col("quality"))
    return cards(spark, sf, placed=True).select("id", F.coalesce("location_id", F.lit(0)).alias("location_id"), F.coalesce("category", F.lit("local")).alias("category"), shown.alias("quality"), F.lit(1).alias("synced"))


@query("SELECT left(md5(concat('master-', cluster_id)), 16) AS id, cluster_id, count(*) AS sources_count, round(min(bias_signed), 4) AS bias_min, round(max(bias_signed), 4) AS bias_max, floor(sum(round(bias_signed * 100)::bigint)::double / count(*))::bigint AS bias_percent FROM cards WHERE cluster_id IS NOT NULL GROUP BY cluster_id", CARDS)
def ing_masters(spark, sf):
    """Master rows of clusters under deterministic ids, so that a second run replaces the first."""
    return masters(cards(spark, sf))


def masters(rows):
    b = F.col("bias_signed")
    per = rows.filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("sources_count"), F.round(F.min(b), 4).alias("bias_min"), F.round(F.max(b), 4).alias("bias_max"), F.floor(F.sum(F.round(b * 100).cast("bigint")) / F.count("*")).cast("bigint").alias("bias_percent"))
    return per.withColumn("id", text.short_id(F.concat(F.lit("master-"), F.col("cluster_id")), 16))


@query("SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM (SELECT " + REJECT_SQL + " AS reason FROM texts) GROUP BY 1", TEXTS)
def ing_split_rejects(spark, sf):
    good, bad = ingest.split_by(texts(spark, sf).select("id", "body"), scoring.rejection(F.col("body"), FAMILIES))
    return rel.counts_by(good.select(F.lit("accepted").alias("outcome")).union(bad.select("reason")), "outcome")


@query("SELECT id, arg_min(s_suppkey, (CASE WHEN s_nationkey < 5 THEN 0 ELSE 1 END, p, s_suppkey)) AS source_id, count(*) AS sources_count FROM (SELECT l_orderkey AS id, l_linenumber AS p, s_suppkey, s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) GROUP BY id")
def ing_denormalise(spark, sf):
    """Per card the first source with a specific location, else the first one."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    rank = F.struct(F.when(F.col("s_nationkey") < 5, 0).otherwise(1), F.col("l_linenumber"), F.col("l_suppkey"))
    joined = table(spark, sf, "lineitem").join(s, "l_suppkey")
    return joined.groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_suppkey", rank).alias("source_id"), F.count("*").alias("sources_count"))


@query("SELECT s_suppkey, coalesce((SELECT max(n_regionkey) FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey > 0), -1)::int AS region_id FROM supplier")
def ing_lookup_update(spark, sf):
    known = table(spark, sf, "nation").filter("n_regionkey > 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    return table(spark, sf, "supplier").join(known, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_regionkey", F.lit(-1)).alias("region_id"))


@query("SELECT source_key, CASE WHEN source_key IN (SELECT source_key FROM attempts WHERE success = 1 AND ts >= TIMESTAMP '2024-01-29') THEN 0 ELSE errors END AS errors FROM (SELECT source_key, count(*) FILTER (success = 0) AS errors FROM attempts GROUP BY 1)", ATTEMPTS)
def ing_error_reset(spark, sf):
    a = attempts(spark, sf)
    errors = a.groupBy("source_key").agg(F.count_if(F.col("success") == 0).alias("errors"))
    well = a.filter("success = 1 and ts >= timestamp_ntz'2024-01-29'").select("source_key").distinct().withColumn("well", F.lit(True))
    return errors.join(well, "source_key", "left").select("source_key", F.when(F.col("well"), F.lit(0)).otherwise(F.col("errors")).alias("errors"))


@query("SELECT page_id, left(md5(url), 8) AS id, left(url, 20) AS title, octet_length(encode(html))::bigint AS n_bytes FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def ing_cards_keyed(spark, sf):
    p = table(spark, sf, "pages")
    seen = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"))
    return p.join(seen, "page_id", "left_anti").select("page_id", text.short_id(F.col("url"), 8).alias("id"), F.left("url", F.lit(20)).alias("title"), F.octet_length("html").cast("bigint").alias("n_bytes"))


# ---- health


@query(f"""SELECT a.source_key, counts, last_method, failures FROM (SELECT source_key, array_to_string(list(concat(method, '=', n::varchar) ORDER BY method), ',') AS counts FROM (SELECT source_key, method, count(*) AS n FROM attempts WHERE success = 1 GROUP BY 1, 2) GROUP BY 1) a
 JOIN (SELECT source_key, arg_max(method, (ts, event_id)) AS last_method FROM attempts WHERE success = 1 GROUP BY 1) b ON a.source_key = b.source_key
 JOIN (SELECT source_key, arg_max(failures, (ts, event_id))::bigint AS failures FROM (SELECT source_key, ts, event_id, sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}) AS failures FROM islands) GROUP BY 1) c ON a.source_key = c.source_key""", ATTEMPTS, ISLANDS)
def health_upsert(spark, sf):
    """The state that upserts would have left, recomputed from the log: counts per method, last method, failures in a row."""
    a = attempts(spark, sf)
    per = a.filter("success = 1").groupBy("source_key", "method").agg(F.count("*").alias("n"))
    as_map = per.groupBy("source_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat("method", F.lit("="), F.col("n").cast("string")))), ",").alias("counts"))
    last = health.last_success(a).select("source_key", F.col("method").alias("last_method"))
    return as_map.join(last, "source_key").join(health.breakers(a).select("source_key", "failures"), "source_key")


@query("SELECT count(*) AS total, count(*) FILTER (success = 1) AS successes, count(DISTINCT source_key) AS sources, (SELECT string_agg(concat(method, ':', n::varchar), ',' ORDER BY method) FROM (SELECT method, count(*) AS n FROM attempts WHERE success = 1 GROUP BY 1)) AS distribution FROM attempts", ATTEMPTS)
def health_learning(spark, sf):
    a = attempts(spark, sf)
    spread = rel.counts_by(a.filter("success = 1"), "method").agg(F.array_join(F.array_sort(F.collect_list(F.concat("method", F.lit(":"), F.col("n").cast("string")))), ",").alias("distribution"))
    return a.agg(F.count("*").alias("total"), F.count_if(F.col("success") == 1).alias("successes"), F.count_distinct("source_key").alias("sources")).crossJoin(spread)  # one row each


@query(f"SELECT CASE WHEN failures >= 3 THEN 'dead' WHEN failures > 0 THEN 'failing' ELSE 'working' END AS status, count(*) AS n FROM (SELECT source_key, arg_max(failures, (ts, event_id)) AS failures FROM (SELECT source_key, ts, event_id, sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}) AS failures FROM islands) GROUP BY 1) GROUP BY 1", ATTEMPTS, ISLANDS)
def health_recovery(spark, sf):
    status = F.when(F.col("failures") >= 3, "dead").when(F.col("failures") > 0, "failing").otherwise("working")
    return rel.counts_by(health.breakers(attempts(spark, sf)).withColumn("status", status), "status")


@query(f"SELECT source_key, failures, CASE WHEN failures >= 3 THEN 1 ELSE 0 END AS is_open FROM (SELECT source_key, arg_max(failures, (ts, event_id))::bigint AS failures FROM (SELECT source_key, ts, event_id, sum(1 - success) OVER (PARTITION BY source_key, island ORDER BY ts, event_id {RUN_SQL}) AS failures FROM islands) GROUP BY 1)", ATTEMPTS, ISLANDS)
def stream_breakers(spark, sf):
    """Breakers kept as state over the stream of attempts; the state after its last batch."""
    log = streams.event_stream(spark, sf).select(F.col("user_id").alias("source_key"), "event_id", F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), 0).otherwise(1).alias("success"), "ts")
    state = streams.breakers(log, streams.shared_folder(spark))
    return state.select("source_key", "failures", (F.col("failures") >= 3).cast("int").alias("is_open"))


# ---- reports


@query("SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS masters, count(*) AS clusters, round((SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') * 100.0 / count(*), 1)::double AS coverage, round(avg(n), 2) AS mean_sources FROM (SELECT cluster_id, count(*) AS n FROM cards WHERE cluster_id IS NOT NULL GROUP BY 1)", CARDS)
def rel_coverage_stats(spark, sf):
    masters = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").agg(F.count("*").alias("masters"))
    sizes = rel.counts_by(cards(spark, sf).filter("cluster_id is not null"), "cluster_id").agg(F.count("*").alias("clusters"), F.round(F.avg("n"), 2).alias("mean_sources"))
    return masters.crossJoin(sizes).withColumn("coverage", text.percent(F.col("masters"), F.col("clusters")))  # one row each


@query("SELECT count(*) AS n, count(*) FILTER (regexp_matches(html, '(?i)<img')) AS with_image, round(count(*) FILTER (regexp_matches(html, '(?i)<img')) * 100.0 / count(*), 1)::double AS share FROM pages")
def rel_image_coverage(spark, sf):
    with_image = F.count_if(F.rlike("html", F.lit("(?i)<img")))
    return table(spark, sf, "pages").agg(F.count("*").alias("n"), with_image.alias("with_image"), text.percent(with_image, F.count("*")).alias("share"))


@query("SELECT band, round(sum(CASE WHEN quality IS NULL THEN 0.5::double ELSE 1 END), 2)::double AS weight, count(*) AS n FROM (SELECT quality, CASE WHEN bias_signed > 0.1 THEN 'official' WHEN bias_signed < -0.1 THEN 'opposition' ELSE 'neutral' END AS band FROM cards) GROUP BY band", CARDS)
def rel_weighted_distribution(spark, sf):
    """Unscored cards weigh half."""
    banded = cards(spark, sf).withColumn("band", labels.bias_band(F.col("bias_signed")))
    return banded.groupBy("band").agg(F.round(F.sum(F.when(F.col("quality").isNull(), 0.5).otherwise(1.0)), 2).alias("weight"), F.count("*").alias("n"))


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN event_type NOT IN ('click', 'purchase', 'signup', 'view') THEN 'type' END, CASE WHEN value > 100 THEN 'value' END, CASE WHEN user_id > 140 THEN 'user' END], lambda x: x IS NOT NULL), ',') AS errors FROM events")
def rel_validation(spark, sf):
    """Errors of each event as a list: an unknown type, a value or a user out of range."""
    checks = [F.when(~F.col("event_type").isin("click", "purchase", "signup", "view"), "type"), F.when(F.col("value") > 100, "value"), F.when(F.col("user_id") > 140, "user")]
    return table(spark, sf, "events").select("event_id", F.array_join(F.array_compact(F.array(*checks)), ",").alias("errors"))


@query("SELECT id, name FROM locations WHERE type = 'region' OR (type = 'nation' AND id > 10)", LOCATIONS)
def rel_client_locations(spark, sf):
    return locations(spark, sf).filter("type = 'region' or (type = 'nation' and id > 10)").select("id", "name")


@query("SELECT id FROM texts WHERE contains(lower(title), 'the') OR contains(lower(summary), 'und')", TEXTS)
def rel_client_search(spark, sf):
    return texts(spark, sf).filter(F.contains(F.lower("title"), F.lit("the")) | F.contains(F.lower("summary"), F.lit("und"))).select("id")


@query("SELECT * FROM cards ORDER BY id LIMIT 50", CARDS)
def rel_cached_scan(spark, sf):
    """The first 50 cards by key, as an offline client keeps them."""
    return rel.top(cards(spark, sf, placed=True), 50, F.col("id"))


@query("SELECT DISTINCT c_name AS name, 'customer' AS origin FROM customer UNION SELECT s_name, 'supplier' FROM supplier WHERE s_name NOT IN (SELECT c_name FROM customer)")
def src_union_tables(spark, sf):
    """Tables of several stores as one, the first store winning."""
    first = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit("customer").alias("origin")).distinct()
    rest = table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("supplier").alias("origin")).distinct()
    return first.unionByName(rel.difference(rest, first, "name").select("name", "origin"))


@query("SELECT conv_id, arg_min(turn, (CASE WHEN length(text) > 200 THEN 0 ELSE 1 END, -length(text), turn)) AS turn FROM conversations WHERE text <> '' GROUP BY conv_id")
def src_candidate_choice(spark, sf):
    """Of the candidates of a key the first with enough text, else the longest."""
    c = table(spark, sf, "conversations").filter("text <> ''").withColumn("size", F.length("text")).withColumn("valid", F.lit(True))
    order = F.struct(F.when(F.col("size") > 200, 0).otherwise(1), -F.col("size"), F.col("turn"))
    return c.groupBy("conv_id").agg(F.min_by("turn", order).alias("turn"))


# ---- functions and texts

#: Pages with what a snippet may carry: a link to a network, empty brackets, a phrase that asks to read on.
SNIPPET = "concat('[Facebook page](http://f/x) [] ', html, ' Leer más')"
CLEAN = f"regexp_replace(replace(regexp_replace({SNIPPET}, '(?i)\\[(Facebook|Twitter|Instagram|LinkedIn|YouTube|TikTok)[^\\]]*\\]\\([^)]*\\)', '', 'g'), '[]', ''), '<[^>]*>', '', 'g')"
for _entity, _plain in text.ENTITIES:
    CLEAN = f"replace({CLEAN}, '{_entity}', '" + _plain.replace("'", "''") + "')"


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({CLEAN}, '(?s)The post.*', ''), '(?i)\\s*Leer más\\s*', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def fn_clean_html(spark, sf):
    told = F.concat(F.lit("[Facebook page](http://f/x) [] "), F.col("html"), F.lit(" Leer más"))
    return table(spark, sf, "pages").select("page_id", text.clean_html(told).alias("plain"))


@query("SELECT doc_id, regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents")
def fn_to_ascii(spark, sf):
    """Whole texts without marks and without what is then not ASCII."""
    return table(spark, sf, "documents").select("doc_id", text.to_ascii("text").alias("plain"))


@query("SELECT id, created_at::date AS day, created_at - INTERVAL 1 HOUR AS overlap_from FROM cards", CARDS)
def fn_dates(spark, sf):
    """Dates parsed back from RFC 822 text."""
    written = F.date_format("created_at", "dd MMM yyyy HH:mm:ss")
    parsed = cards(spark, sf).select("id", times.parse_date(F.concat(F.lit("Mon, "), written, F.lit(" GMT"))).cast("timestamp_ntz").alias("at"))
    return parsed.select("id", F.to_date("at").alias("day"), (F.col("at") - F.expr("INTERVAL 1 HOUR")).alias("overlap_from"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<img[^>]*src=[\"'']([^\"'']+)[\"'']', 1))::bigint AS n_images FROM pages")
def fn_media(spark, sf):
    found = F.regexp_extract_all("html", F.lit("(?i)<img[^>]*src=[\"']([^\"']+)[\"']"), F.lit(1))
    return table(spark, sf, "pages").select("page_id", F.size(found).cast("bigint").alias("n_images"))


@query("SELECT page_id, array_to_string(CASE WHEN regexp_matches(lower(url), 'youtube|vimeo') THEN ['video', 'rss', 'wordpress', 'sitemap', 'article', 'reader'] ELSE ['rss', 'wordpress', 'sitemap', 'article', 'reader'] END, ',') AS methods FROM pages")
def fn_methods(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(urls.methods(F.col("url")), ",").alias("methods"))


@query("SELECT id, round(0.6::double * bias_signed + 0.4::double * coalesce(quality, bias_signed), 4) AS blended FROM cards", CARDS)
def txt_blend(spark, sf):
    """A heuristic score and a model's, which is a column: 0.6 and 0.4, or the first alone."""
    return cards(spark, sf).select("id", F.round(F.col("bias_signed") * 0.6 + F.coalesce("quality", "bias_signed") * 0.4, 4).alias("blended"))


@query("SELECT cluster_id, concat('Facts: ', summary) AS prompt FROM (SELECT cluster_id, string_agg(sentence, '; ' ORDER BY rank) AS summary FROM facts WHERE rank <= 3 GROUP BY 1)", ARTICLES, SENTENCES, FACTS)
def txt_prompt(spark, sf):
    found = facts.facts(facts.sentence_rows(_articles(spark, sf)), most=3)
    joined = found.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), "; ").alias("summary"))
    return joined.select("cluster_id", F.format_string("Facts: %s", F.col("summary")).alias("prompt"))


@query(f"""WITH near AS (SELECT v.vec_id AS id, max({COS}) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1)
 SELECT id, 'words' AS kind, score FROM ({bm25_sql(["the", "with"])}) UNION ALL SELECT id, 'vector', round(score, 4) FROM near WHERE score >= 0.3""", TEXTS)
def txt_hybrid(spark, sf):
    """Keyword results and vector matches side by side, each with its own score; they are not fused."""
    words = search.bm25(texts(spark, sf).select("id", F.col("body").alias("text")), ["the", "with"]).select("id", F.lit("words").alias("kind"), "score")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    near = vectors.vector_scores(v.filter("id % 50 = 0"), v, least=0.3).groupBy("id").agg(F.round(F.max("score"), 4).alias("score")).select("id", F.lit("vector").alias("kind"), "score")
    return words.unionByName(near)


@query(f"SELECT query_id, id, 'words' AS kind, score FROM ({ORACLES['txt_search_index']}) UNION ALL SELECT query_id, id, 'vector', score FROM ({ORACLES['vec_cosine_topk']})")
def txt_hybrid_index(spark, sf):
    """The same for a table of queries, both kinds from their index."""
    kind = lambda df, name: df.select("query_id", "id", F.lit(name).alias("kind"), "score")
    return kind(txt_search_index(spark, sf), "words").unionByName(kind(vec_index_exact(spark, sf), "vector"))


@query("SELECT cluster_id, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'disputed') AS disputed, max(frequency) AS most FROM (SELECT *, CASE WHEN frequency >= 3 THEN 'verified' ELSE 'disputed' END AS status FROM facts) GROUP BY 1", ARTICLES, SENTENCES, FACTS)
def facts_synthesis(spark, sf):
    """What the synthesis of each cluster would rest on: all its sentences, not only those that are shown."""
    found = facts.counted(facts.sentence_rows(_articles(spark, sf)))
    return found.groupBy("cluster_id").agg(F.count_if(F.col("status") == "verified").alias("verified"), F.count_if(F.col("status") == "disputed").alias("disputed"), F.max("frequency").alias("most"))


@query("SELECT page_id, strlen(html)::bigint AS n_bytes, regexp_matches(html, '(?i)<rss|<feed|<rdf') AS is_feed FROM pages")
def html_is_feed(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.octet_length("html").cast("bigint").alias("n_bytes"), markup.is_feed(F.col("html")).alias("is_feed"))
