"""Clusters kept over time, rankings and reports of sources, and batches of work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewire.functions import labels, text
from tidewire.operators import clusters, facts, health, ingest, vectors
from tidewire.operators import relational as rel
from tidewire.plans import ATTEMPTS, CARDS, TEXTS, query
from tidewire.plans.content import ARTICLES, COS, FACTS, SENTENCES, SIG_WORDS, TITLE, _articles, _vectors
from tidewire.plans.feed import DOMAIN_SQL
from tidewire.plans.logs import SCORE_SQL
from tidewire.sources.roles import EVENTS_AS_OF, attempts, cards, table, texts

# ---- clusters

SIGNATURE = f"array_to_string(list_sort(list_slice(list_sort(list_transform(list_distinct({SIG_WORDS.format(TITLE)}), lambda w: (-length(w), w))), 1, 6).list_transform(lambda x: x[2])), '|')"
#: Titles are cards of a month; those of labelled documents have their cluster already.
RECENT = f"""stamped AS (SELECT t.id, t.title, {SIGNATURE.replace('title', 't.title')} AS signature, TIMESTAMP '2024-01-01' + to_days((t.id % 30)::int) AS created_at, CASE WHEN l.doc_id IS NOT NULL THEN 'old' END AS cluster_id FROM texts t LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON t.id = l.doc_id),
 due AS (SELECT * FROM stamped WHERE cluster_id IS NULL AND created_at >= TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR)"""


def _stamped(spark, sf):
    known = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.lit("old").alias("cluster_id")).distinct()
    created = F.expr("timestamp_ntz'2024-01-01'") + F.make_dt_interval(F.col("id") % 30)
    return texts(spark, sf).select("id", "title", created.alias("created_at")).join(known, "id", "left")


@query("""SELECT id, CASE WHEN cluster_id IS NOT NULL THEN cluster_id WHEN id IN (SELECT id FROM due) AND signature <> '' AND signature IN (SELECT signature FROM due GROUP BY 1 HAVING count(*) >= 2) THEN left(md5(signature), 12) END AS cluster_id FROM stamped""", TEXTS, RECENT)
def clu_recent(spark, sf):
    """Cards of the last ten days without a cluster are clustered; the ids are written back, old clusters stay."""
    c = _stamped(spark, sf)
    return clusters.written_back(c, clusters.by_signature(clusters.unclustered(c, EVENTS_AS_OF, hours=240))).select("id", "cluster_id")


@query("SELECT id, CASE WHEN id IN (SELECT page_id FROM pages) AND signature <> '' AND signature IN (SELECT signature FROM stamped WHERE id IN (SELECT page_id FROM pages) GROUP BY 1 HAVING count(*) >= 2) THEN left(md5(signature), 12) ELSE cluster_id END AS cluster_id FROM stamped", TEXTS, RECENT)
def clu_given_ids(spark, sf):
    """The cards whose ids a table lists are clustered anew and written back."""
    c = _stamped(spark, sf)
    asked = table(spark, sf, "pages").select(F.col("page_id").alias("id")).distinct()
    return clusters.written_back(c, clusters.by_signature(c.join(asked, "id", "left_semi")), again=True).select("id", "cluster_id")


def leaders_sql(least: float) -> str:
    """Goes through the vectors one by one; a vector with a leader among its earlier neighbours belongs to the first."""
    return f"""WITH RECURSIVE near AS (SELECT v.vec_id AS id, list(q.vec_id ORDER BY q.vec_id) AS earlier FROM embeddings q JOIN embeddings v ON q.vec_id < v.vec_id WHERE {COS} >= {least}::double GROUP BY 1),
 rows AS (SELECT vec_id AS id, coalesce(earlier, []) AS earlier, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings LEFT JOIN near ON vec_id = id),
 steps AS (SELECT 0::bigint AS i, []::bigint[] AS leaders UNION ALL SELECT rows.i, CASE WHEN list_has_any(leaders, earlier) THEN leaders ELSE list_append(leaders, id) END FROM steps JOIN rows ON rows.i = steps.i + 1),
 done AS (SELECT arg_max(leaders, i) AS leaders FROM steps)
 SELECT id, coalesce(list_filter(earlier, lambda x: list_contains(leaders, x))[1], id) AS leader FROM rows, done"""


@query(leaders_sql(0.85))
def vec_leaders(spark, sf):
    """Each vector with the first leader at a cosine of 0.85 or more, or as a leader itself."""
    return vectors.leaders(_vectors(spark, sf), 0.85)


@query(leaders_sql(0.3))
def vec_wide_leaders(spark, sf):
    """The same at 0.3, where groups are large; rounds go on until a hundred vectors are left."""
    return vectors.leaders(_vectors(spark, sf), 0.3, few=100)


WHOLE_SETS = "sets AS (SELECT min(doc_id) AS set_id, ws AS words FROM (SELECT doc_id, list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) >= 3))) AS ws FROM documents WHERE text IS NOT NULL) WHERE len(ws) > 0 GROUP BY ws)"


@query("SELECT a, b, score FROM (SELECT x.set_id AS a, y.set_id AS b, round(len(list_intersect(x.words, y.words))::double / (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words))), 4) AS score FROM sets x JOIN sets y ON x.set_id < y.set_id AND len(x.words) >= 0.8 * len(y.words) AND len(y.words) >= 0.8 * len(x.words)) WHERE score >= 0.8", WHOLE_SETS)
def clu_text_edges(spark, sf):
    """Similar word sets of whole texts."""
    whole = table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    return clusters.similar_sets(clusters.word_sets(whole), least=0.8)


# ---- batches of work


@query("""SELECT cluster_id, n, CASE WHEN n < 2 THEN 'skipped' WHEN verified = 0 THEN 'failed' ELSE 'success' END AS outcome FROM (SELECT c.cluster_id, c.n, coalesce(v.verified, 0) AS verified FROM (SELECT cluster_id, count(*) AS n FROM articles GROUP BY 1) c
 LEFT JOIN (SELECT cluster_id, count(*) FILTER (frequency >= 3) AS verified FROM facts GROUP BY 1) v ON c.cluster_id = v.cluster_id WHERE c.cluster_id NOT IN (SELECT arg_max(source, (n, source)) FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1)) ORDER BY n DESC, cluster_id LIMIT 100)""", ARTICLES, SENTENCES, FACTS)
def facts_batch(spark, sf):
    """Clusters without a master, largest first, and how the synthesis of each ends; the largest one has its master."""
    a = _articles(spark, sf)
    sizes = rel.counts_by(a, "cluster_id")
    mastered = rel.top(sizes, 1, F.desc("n"), F.desc("cluster_id")).select("cluster_id")
    return facts.batch(sizes, facts.counted(facts.sentence_rows(a)), mastered)


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN value > 400 THEN 'failed' WHEN event_type = 'view' THEN 'skipped' ELSE 'success' END AS outcome FROM events) GROUP BY 1")
def rel_batch_outcomes(spark, sf):
    outcome = F.when(F.col("value") > 400, "failed").when(F.col("event_type") == "view", "skipped").otherwise("success")
    return rel.counts_by(table(spark, sf, "events").withColumn("outcome", outcome), "outcome")


@query("SELECT 1 AS pass, id FROM (SELECT id FROM cards WHERE quality IS NULL AND bias_signed = 0 ORDER BY created_at DESC, id DESC LIMIT 100) UNION ALL SELECT 2, id FROM (SELECT id FROM cards WHERE quality IS NULL ORDER BY created_at DESC, id DESC LIMIT 100)", CARDS)
def rel_unanalysed(spark, sf):
    """The newest cards of the two passes of analysis: no quality and no bias yet, then no quality."""
    todo = cards(spark, sf).filter("quality is null")
    first = rel.newest(todo.filter("bias_signed = 0"), 100).select(F.lit(1).alias("pass"), "id")
    return first.union(rel.newest(todo, 100).select(F.lit(2), "id"))


@query("SELECT source_key, errors FROM (SELECT source_key, count(*) FILTER (success = 0) AS errors, max(ts) AS seen FROM attempts GROUP BY 1) WHERE errors >= 5 AND seen >= TIMESTAMP '2024-01-29' ORDER BY errors DESC, source_key LIMIT 100", ATTEMPTS)
def rel_failed_sources(spark, sf):
    """Sources with five errors or more that are still active."""
    per = attempts(spark, sf).groupBy("source_key").agg(F.count_if(F.col("success") == 0).alias("errors"), F.max("ts").alias("seen"))
    return rel.top(per.filter("errors >= 5 and seen >= timestamp_ntz'2024-01-29'").select("source_key", "errors"), 100, F.desc("errors"), F.col("source_key"))


@query("SELECT id, created_at::date AS day, category = 'O' AS was_rfc FROM cards", CARDS)
def ing_rfc_dates(spark, sf):
    """Dates of which some were stored as RFC 822 text: those are found by their comma and rewritten."""
    from tidewire.functions.times import parse_date

    stored = F.when(F.col("category") == "O", F.date_format("created_at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    rows = cards(spark, sf).select("id", stored.alias("stored")).withColumn("was_rfc", F.like("stored", F.lit("%, %")))
    return rows.select("id", F.to_date(F.when(F.col("was_rfc"), parse_date(F.col("stored"))).otherwise(F.try_to_timestamp("stored"))).alias("day"), "was_rfc")


@query("SELECT id FROM cards WHERE source_id IN (1, 5, 7, 11, 50) AND bias_signed < -0.1", CARDS)
def feed_followed(spark, sf):
    """Cards of followed sources; an empty list would filter nothing."""
    return cards(spark, sf).filter(rel.card_filter(EVENTS_AS_OF, sources=[1, 5, 7, 11, 50], bias="opposition")).filter(rel.card_filter(EVENTS_AS_OF, sources=[])).select("id")


@query("SELECT event_id, array_to_string(list_filter([CASE WHEN NOT (value BETWEEN 1 AND 100) THEN 'limit' END, CASE WHEN event_id - 5 < 0 THEN 'offset' END, CASE WHEN user_id - 75 > 90 OR user_id - 75 < -90 THEN 'latitude' END, CASE WHEN value * 300 > 86400 THEN 'dwell' END, CASE WHEN value / 100 > 1 THEN 'scroll' END, CASE WHEN event_type NOT IN ('click', 'view') THEN 'kind' END], lambda x: x IS NOT NULL), ',') AS errors FROM events")
def rel_validation_ranges(spark, sf):
    """Requests (made of event columns) against ranges and enumerations, with the list of what is wrong."""
    e, v = table(spark, sf, "events"), F.col("value")
    limits = {"limit": (v, 1, 100), "offset": (F.col("event_id") - 5, 0, None), "latitude": (F.col("user_id") - 75, -90, 90), "dwell": (v * 300, 0, 86400), "scroll": (v / 100, 0, 1)}
    return e.select("event_id", F.array_join(rel.range_errors(limits, {"kind": (F.col("event_type"), ["click", "view"])}), ",").alias("errors"))


# ---- sources and places


@query("SELECT s_suppkey, s_name, coalesce(n, 0) AS n, coalesce(errors, 0) AS errors, last_at FROM supplier JOIN (SELECT source_key, count(*) AS n, count(*) FILTER (success = 0) AS errors, max(ts) FILTER (success = 1) AS last_at FROM attempts GROUP BY 1) h ON s_suppkey = h.source_key", ATTEMPTS)
def rel_sources_health(spark, sf):
    per = attempts(spark, sf).groupBy(F.col("source_key").alias("s_suppkey")).agg(F.count("*").alias("n"), F.count_if(F.col("success") == 0).alias("errors"), F.max(F.when(F.col("success") == 1, F.col("ts"))).alias("last_at"))
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").join(per, "s_suppkey")


@query("SELECT n_name, r_name, coalesce(n, 0) AS n FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT a.n_name AS name, b.r_name AS region, count(*) AS n FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN region b ON a.n_regionkey = b.r_regionkey WHERE s_acctbal > 5000 GROUP BY 1, 2) c ON n_name = c.name AND r_name = c.region ORDER BY n, n_name")
def rel_coverage_map(spark, sf):
    """Sources per place, keyed by its name and its region's, 0 where there is none."""
    places = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "r_name")
    covered = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).join(places, "n_nationkey").groupBy("n_name", "r_name").agg(F.count("*").alias("n"))
    return places.join(covered, ["n_name", "r_name"], "left").select("n_name", "r_name", F.coalesce("n", F.lit(0)).alias("n")).orderBy("n", "n_name")


@query("SELECT n_name, count(*) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY population DESC, n_name")
def rel_by_population(spark, sf):
    """All places, most people first."""
    per = rel.counts_by(table(spark, sf, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), "n_nationkey")
    return table(spark, sf, "nation").join(per, "n_nationkey").select("n_name", F.col("n").alias("population")).orderBy(F.desc("population"), "n_name")


@query("SELECT cluster_id, count(*) AS n, max(created_at) AS last_at FROM cards WHERE cluster_id IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (bias_signed > 0.1) = 0 OR count(*) FILTER (bias_signed < -0.1) = 0 ORDER BY max(created_at) DESC, cluster_id LIMIT 25", CARDS)
def rel_blindspot_newest(spark, sf):
    """Clusters that one side does not cover, by their latest card."""
    side = lambda c: F.count_if(c)
    per = cards(spark, sf).filter("cluster_id is not null").groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"), side(F.col("bias_signed") > 0.1).alias("pro"), side(F.col("bias_signed") < -0.1).alias("anti"))
    return rel.top(per.filter("pro = 0 or anti = 0").select("cluster_id", "n", "last_at"), 25, F.desc("last_at"), F.col("cluster_id"))


@query("SELECT cluster_id FROM (SELECT cluster_id, count(*) AS n FROM cards WHERE cluster_id IS NOT NULL GROUP BY 1) ORDER BY n DESC, cluster_id LIMIT 40", CARDS)
def rel_largest_clusters(spark, sf):
    return rel.top(rel.counts_by(cards(spark, sf).filter("cluster_id is not null"), "cluster_id"), 40, F.desc("n"), F.col("cluster_id")).select("cluster_id")


@query(f"WITH {ATTEMPTS}, best AS (SELECT source_key, arg_min(method, (-score, method)) AS best FROM (SELECT source_key, method, {SCORE_SQL} FROM attempts GROUP BY 1, 2) GROUP BY 1) SELECT source_key, array_to_string(list(name ORDER BY CASE WHEN name = best THEN 0 ELSE 1 END, p), ',') AS methods FROM best, (VALUES ('purchase', 1), ('signup', 2), ('click', 3), ('view', 4), ('error', 5)) v(name, p) GROUP BY 1")
def health_learned_order(spark, sf):
    """Per source the methods by priority, the learned best one moved to the front."""
    best = health.best_methods(health.method_scores(attempts(spark, sf), "source_key"), "source_key")
    return best.select("source_key", F.array_join(health.learned_first(F.col("method"), ["purchase", "signup", "click", "view", "error"]), ",").alias("methods"))


@query(f"SELECT source_key, hour, method, score, row_number() OVER (PARTITION BY source_key, hour ORDER BY score DESC, method) AS rank FROM (SELECT source_key, hour(ts)::int AS hour, method, {SCORE_SQL} FROM attempts GROUP BY 1, 2, 3)", ATTEMPTS)
def health_by_source_hour(spark, sf):
    scores = health.method_scores(attempts(spark, sf).withColumn("hour", F.hour("ts")), "source_key", "hour")
    return rel.ranked_within(scores, "rank", ["source_key", "hour"], F.desc("score"), F.col("method")).select("source_key", "hour", "method", "score", "rank")


PROBES = "probes AS (SELECT source_key, bool_or(method = 'view' AND success = 1 AND duration_ms > 40000) AS rss, bool_or(method = 'click' AND success = 1 AND duration_ms > 45000) AS wp, bool_or(method = 'signup' AND success = 1 AND duration_ms > 20000) AS sitemap FROM attempts WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1)"


@query("SELECT source_key, CASE WHEN rss THEN 'rss' WHEN wp THEN 'wp' WHEN sitemap THEN 'sitemap' ELSE 'dead' END AS status FROM probes", ATTEMPTS, PROBES)
def health_recovery_probes(spark, sf):
    """What each source comes back by: the first probe that answers, in order, else it is dead."""
    a = attempts(spark, sf).filter("ts >= timestamp_ntz'2024-01-25'")
    probe = lambda m, least: F.bool_or((F.col("method") == m) & (F.col("success") == 1) & (F.col("duration_ms") > least))
    per = a.groupBy("source_key").agg(probe("view", 40000).alias("rss"), probe("click", 45000).alias("wp"), probe("signup", 20000).alias("sitemap"))
    return per.select("source_key", F.coalesce(*[F.when(F.col(c), c) for c in ("rss", "wp", "sitemap")], F.lit("dead")).alias("status"))


# ---- reports


@query("SELECT CASE WHEN s < 0.25 THEN 'left' WHEN s < 0.42 THEN 'centre-left' WHEN s < 0.58 THEN 'centre' WHEN s < 0.75 THEN 'centre-right' ELSE 'right' END AS side, count(*) AS n FROM (SELECT (bias_signed + 1) / 2 AS s FROM cards) GROUP BY 1", CARDS)
def rel_unit_histogram(spark, sf):
    from tidewire.operators.lexicon import side

    return rel.counts_by(cards(spark, sf).withColumn("side", side((F.col("bias_signed") + 1) / 2)), "side")


@query("""SELECT 'cards' AS metric, count(*)::bigint AS n FROM cards UNION ALL SELECT 'clusters', count(DISTINCT cluster_id) FROM cards UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'failing', count(DISTINCT s_suppkey) FROM supplier JOIN attempts ON s_suppkey = source_key WHERE success = 0
 UNION ALL SELECT 'placed', count(*) FROM cards JOIN customer ON source_id = c_custkey UNION ALL SELECT concat('quality ', q::varchar), count(*) FROM (SELECT floor(coalesce(quality, 0) * 5)::int AS q FROM cards) GROUP BY q UNION ALL SELECT concat('bias ', b), count(*) FROM (SELECT CASE WHEN bias_signed > 0.1 THEN 'official' WHEN bias_signed < -0.1 THEN 'opposition' ELSE 'neutral' END AS b FROM cards) GROUP BY b""", CARDS, ATTEMPTS)
def rel_dashboard_full(spark, sf):
    """Counts of tables, counts over joins, and two histograms, one row each."""
    c, a, s = cards(spark, sf), attempts(spark, sf), table(spark, sf, "supplier")
    one = lambda name, frame, n=None: frame.agg((F.count("*") if n is None else n).alias("n")).select(F.lit(name).alias("metric"), "n")
    failing = a.filter("success = 0").select(F.col("source_key").alias("s_suppkey")).distinct()
    placed = table(spark, sf, "customer").select(F.col("c_custkey").alias("source_id"))
    histogram = lambda name, value: c.groupBy(F.concat(F.lit(name), value.cast("string")).alias("metric")).agg(F.count("*").alias("n"))
    parts = [one("cards", c), one("clusters", c, F.count_distinct("cluster_id")), one("sources", s), one("failing", s.join(failing, "s_suppkey", "left_semi")), one("placed", c.join(placed, "source_id")), histogram("quality ", F.floor(F.coalesce("quality", F.lit(0.0)) * 5).cast("int")), histogram("bias ", labels.bias_band(F.col("bias_signed")))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT cluster_id, side, share FROM (SELECT cluster_id, side, floor(n * 100.0 / sum(n) OVER (PARTITION BY cluster_id) + 0.5)::bigint AS share FROM (SELECT cluster_id, CASE WHEN bias_signed > 0.1 THEN 'official' WHEN bias_signed < -0.1 THEN 'opposition' ELSE 'neutral' END AS side, count(*) AS n FROM cards WHERE cluster_id IS NOT NULL GROUP BY 1, 2)) WHERE share > 0", CARDS)
def rel_voices_present(spark, sf):
    """Shares of voices per cluster, without those that are none."""
    wide = rel.voices(cards(spark, sf))
    long = wide.select("cluster_id", F.explode(F.array(*[F.struct(F.lit(k).alias("side"), F.col(k).alias("share")) for k in ("official", "neutral", "opposition")])).alias("x")).select("cluster_id", "x.*")
    return long.filter("share > 0")


@query("SELECT side, round(sum(CASE WHEN b IS NULL THEN 0.5::double ELSE 1 END), 2)::double AS weight, round(sum(round(coalesce(b, 0) * 100)::bigint)::double / 100 / count(*), 4) AS mean_bias FROM (SELECT b, CASE WHEN b > 0.1 THEN 'official' WHEN b < -0.1 THEN 'opposition' ELSE 'neutral' END AS side FROM (SELECT CASE WHEN quality IS NULL THEN NULL ELSE bias_signed END AS b FROM cards)) GROUP BY side", CARDS)
def rel_weighted_bias(spark, sf):
    """Cards without a bias weigh half and are neutral; bias counts as known where quality is."""
    b = F.when(F.col("quality").isNotNull(), F.col("bias_signed"))
    rows = cards(spark, sf).select(b.alias("b")).withColumn("side", labels.bias_band(F.col("b")))
    cents = F.sum(F.round(F.coalesce("b", F.lit(0.0)) * 100).cast("bigint")).cast("double") / 100
    return rows.groupBy("side").agg(F.round(F.sum(F.when(F.col("b").isNull(), 0.5).otherwise(1.0)), 2).alias("weight"), F.round(cents / F.count("*"), 4).alias("mean_bias"))


@query(f"SELECT {DOMAIN_SQL} AS domain, (page_id // 1000)::bigint AS part, array_to_string(list(page_id ORDER BY page_id), ',') AS ids FROM pages GROUP BY 1, 2")
def rel_domain_lists(spark, sf):
    """Pages listed by domain, in parts of a thousand ids, so that no list grows without bound."""
    from tidewire.functions.urls import domain

    p = table(spark, sf, "pages").select(domain(F.col("url")).alias("domain"), F.floor(F.col("page_id") / 1000).alias("part"), "page_id")
    return p.groupBy("domain", "part").agg(F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("ids"))


@query("SELECT conv_id, 'Facts:' || chr(10) || string_agg(concat('- ', left(text, 40)), chr(10) ORDER BY turn) FILTER (turn < 4) || chr(10) || concat('Turns: ', count(*)::varchar) AS prompt FROM conversations WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (turn < 4) > 0")
def txt_prompt_lines(spark, sf):
    """A prompt of several lines per conversation: its first turns and their number."""
    c = table(spark, sf, "conversations").filter("text is not null")
    first = F.array_sort(F.collect_list(F.when(F.col("turn") < 4, F.struct("turn", F.concat(F.lit("- "), F.left("text", F.lit(40))).alias("line")))))
    rows = c.groupBy("conv_id").agg(first.alias("first"), F.count("*").alias("n")).filter(F.size("first") > 0)
    return rows.select("conv_id", F.format_string("Facts:\n%s\nTurns: %d", F.array_join(F.transform("first", lambda x: x["line"]), "\n"), F.col("n")).alias("prompt"))


@query("SELECT id, concat('https://wa.me/?text=', url_encode(concat('*', t, '*', CASE WHEN bias > 0 THEN concat(' (+', b, ')') ELSE concat(' (', b, ')') END, chr(10), '/item/', id::varchar))) AS link FROM (SELECT id, regexp_replace(title, '[^A-Za-z0-9 ]', '', 'g') AS t, ((id * 37) % 201 - 100) AS bias, printf('%.2f', ((id * 37) % 201 - 100)::double / 100) AS b FROM texts WHERE title IS NOT NULL)", TEXTS)
def txt_share_links(spark, sf):
    """Links that share a title with its bias; blanks and line ends are encoded."""
    from tidewire.functions.urls import encoded

    bias = ((F.col("id") * 37) % 201 - 100).cast("double") / 100
    shown = F.concat(F.lit(" ("), F.when(bias > 0, F.lit("+")).otherwise(F.lit("")), F.format_string("%.2f", bias), F.lit(")"))
    message = F.concat(F.lit("*"), F.regexp_replace("title", "[^A-Za-z0-9 ]", ""), F.lit("*"), shown, F.lit("\n/item/"), F.col("id").cast("string"))
    # The star is left as it is by one encoder and not by the other.
    link = F.concat(F.lit("https://wa.me/?text="), F.replace(encoded(message), F.lit("*"), F.lit("%2A")))
    return texts(spark, sf).filter("title is not null").select("id", link.alias("link"))


@query("SELECT concat('<url><loc>https://news.example/', lower(regexp_replace(name, '\\s+', '-', 'g')), '</loc></url>') AS entry FROM (SELECT n_name AS name, 'nation' AS type FROM nation UNION ALL SELECT r_name, 'region' FROM region) WHERE type = 'region'")
def txt_sitemap_regions(spark, sf):
    """The sitemap of one type of place."""
    from tidewire.sources.roles import locations

    return locations(spark, sf).filter("type = 'region'").select(F.format_string("<url><loc>https://news.example/%s</loc></url>", text.slug(F.col("name"))).alias("entry"))


@query("SELECT page_id, CASE WHEN trim(s) = '' THEN concat('More about ', url) ELSE s END AS summary FROM (SELECT page_id, url, CASE WHEN url LIKE 'https:%' THEN '  ' ELSE left(html, 30) END AS s FROM pages)")
def ing_card_defaults(spark, sf):
    """Cards with a default where the summary is blank; those over https have a blank one."""
    s = F.when(F.startswith("url", F.lit("https:")), "  ").otherwise(F.left("html", F.lit(30)))
    return table(spark, sf, "pages").select("page_id", ingest.default_text(s, F.concat(F.lit("More about "), F.col("url"))).alias("summary"))


@query("SELECT doc_id, coalesce(n.label, o.quality) AS quality FROM (SELECT doc_id, any_value(quality) AS quality FROM labels GROUP BY 1) o FULL JOIN (SELECT vec_id, label FROM embeddings WHERE label > 2) n ON doc_id = vec_id WHERE doc_id IS NOT NULL")
def ing_upsert_values(spark, sf):
    """Values of known rows replaced where a newer table has one."""
    old = table(spark, sf, "labels").groupBy("doc_id").agg(F.any_value("quality").alias("quality"))
    new = table(spark, sf, "embeddings").filter("label > 2").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("quality"))
    return ingest.enrich(old, new, "doc_id", ["quality"]).select("doc_id", "quality")


@query("SELECT vec_id, label, CASE WHEN page_id IS NULL THEN round(embedding[1]::double, 6) ELSE 1.0::double END AS head FROM embeddings LEFT JOIN pages ON vec_id = page_id UNION ALL SELECT page_id, -1, 1.0::double FROM pages WHERE page_id NOT IN (SELECT vec_id FROM embeddings)")
def ing_vector_upsert(spark, sf):
    """Vectors of pages replace those of the same id, or are added."""
    v = table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("head"))
    new = table(spark, sf, "pages").select(F.col("page_id").alias("vec_id"), F.lit(1.0).alias("head"))
    return ingest.upserted(v, new, "vec_id", {"label": F.lit(-1)}).select("vec_id", "label", F.round("head", 6).alias("head"))


@query("SELECT source_key, count(*) AS n FROM attempts WHERE source_key NOT IN (SELECT source_key FROM attempts WHERE method = 'error' GROUP BY 1 HAVING count(*) > 14) GROUP BY 1", ATTEMPTS)
def ing_reset_keys(spark, sf):
    """The log without the keys that are reset."""
    a = attempts(spark, sf)
    reset = rel.counts_by(a.filter("method = 'error'"), "source_key").filter("n > 14").select("source_key")
    return rel.counts_by(ingest.without_keys(a, reset, "source_key"), "source_key")


@query("SELECT kind, name, place FROM (SELECT 'customer' AS kind, c_name AS name, n_name AS place, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'supplier', s_name, n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'place', r_name, r_name, r_regionkey FROM region UNION ALL SELECT 'part', p_name, p_brand, p_partkey FROM part UNION ALL SELECT 'label', CAST(doc_id AS varchar), CAST(quality AS varchar), doc_id FROM labels)")
def ing_sync_tables(spark, sf):
    """Five tables in the form in which they are sent on, places named instead of numbered."""
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    pick = lambda t, kind, name, place: table(spark, sf, t).select(F.lit(kind).alias("kind"), F.col(name).cast("string").alias("name"), F.col(place).cast("string").alias("place"))
    placed = lambda t, kind, name, key: table(spark, sf, t).join(nation.withColumnRenamed("n_nationkey", key), key).select(F.lit(kind).alias("kind"), F.col(name).alias("name"), "place")
    rows = placed("customer", "customer", "c_name", "c_nationkey").unionByName(placed("supplier", "supplier", "s_name", "s_nationkey"))
    return rows.unionByName(pick("region", "place", "r_name", "r_name")).unionByName(pick("part", "part", "p_name", "p_brand")).unionByName(pick("labels", "label", "doc_id", "quality"))


@query("SELECT id, s_name AS source_name, n_name AS place FROM (SELECT l_orderkey AS id, arg_min(s_suppkey, (CASE WHEN s_nationkey < 5 THEN 0 ELSE 1 END, l_linenumber, s_suppkey)) AS source_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) x JOIN supplier ON x.source_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey")
def ing_denormalise_names(spark, sf):
    """Cards pointed at the name and the place of the source that speaks for them."""
    from tidewire.plans.desk import ing_denormalise

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("place"))
    return ing_denormalise(spark, sf).join(s, "source_id").join(n, "n_nationkey").select("id", "source_name", "place")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN body IS NULL OR length(body) < 60 THEN 'rejected' WHEN quality_flag = 1 THEN 'synced' WHEN quality_flag = 0 THEN 'cleaned' ELSE 'processed' END AS status FROM texts) GROUP BY 1", TEXTS)
def ing_status_queue(spark, sf):
    """Items moved through their states: rejected by the cleaner, cleaned, published, or waiting for it."""
    t = texts(spark, sf).withColumn("status", F.lit("pending"))
    return rel.counts_by(ingest.moved(t, [("pending", "rejected", F.col("body").isNull() | (F.length("body") < 60)), ("pending", "processed", F.lit(True)), ("processed", "cleaned", F.col("quality_flag").isNotNull()), ("cleaned", "synced", F.col("quality_flag") == 1)]), "status")
