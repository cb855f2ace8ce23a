"""Texts, facts, clusters, vectors and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.functions import labels, text, times, urls
from tidewire.operators import clusters, facts, lexicon, scoring, search, textindex, vectors
from tidewire.operators import relational as rel
from tidewire.plans import CARDS, ORACLES, TEXTS, query
from tidewire.sources import markup
from tidewire.sources.roles import cards, table, texts
from tidewire.streaming.streams import shared_folder

# Word lists of the queries, from words that are frequent in the tables' invented prose.
TOPICS = {"east": ["the", "and", "of"], "west": ["die", "und", "der"], "south": ["la", "les", "des"]}
PRO, ANTI = ["the", "with", "que"], ["and", "worthless", "pathetic"]
RIGHT, LEFT = ["of the", "und", "ing "], ["in the", "que ", "ed th"]
NAMES = {"than": 0.8, "ouer": 0.2, "ment": 0.6}
REGISTRY = [("src1", 0.7, 0.8), ("src2", 0.3, 0.9), ("src", 0.5, 0.3)]
OPINION, NEWS = ["this", "should", "le "], ["the", "said"]
ERRORS = ["404 not found", "access denied", "lorem ipsum", r"\|", "%%%"]
FAMILIES = [("symbols", r"[#$%&*]{3}"), ("table", r" \| "), ("insult", "worthless|pathetic"), ("secret", "password|token")]

FOLD = "strip_accents(lower({0}))"
NORM = "trim(regexp_replace(regexp_replace(translate(lower({0}), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), '[^a-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
BODY, TITLE = NORM.format("body"), NORM.format("title")
SIG_WORDS = "list_filter(string_split({0}, ' '), lambda w: length(w) >= 3)"


def _sql_list(terms) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _word_hits(terms) -> str:
    return f"len(list_intersect({_sql_list(terms)}, string_split({BODY}, ' ')))"


def _phrase_hits(terms) -> str:
    folded = "translate(lower(body), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc')"
    return f"len(list_filter({_sql_list(terms)}, lambda t: contains({folded}, t)))"


def _ladder(scores: dict[str, str], default: str) -> str:
    best = f"greatest({', '.join(scores.values())}, 0)"
    return f"CASE WHEN {best} <= 0 THEN '{default}' " + " ".join(f"WHEN {v} = {best} THEN '{k}'" for k, v in scores.items()) + f" ELSE '{default}' END"


# ---- scalar functions


@query(f"SELECT id, {TITLE} AS normal, array_to_string(list_sort(list_slice(list_sort(list_transform(list_distinct({SIG_WORDS.format(TITLE)}), lambda w: (-length(w), w))), 1, 6).list_transform(lambda x: x[2])), '|') AS signature FROM texts", TEXTS)
def fn_signature(spark, sf):
    return texts(spark, sf).select("id", text.normalise(F.col("title")).alias("normal"), text.signature(F.col("title")).alias("signature"))


@query("SELECT page_id, left(md5(url), 12) AS short_id, left(sha256(lower(regexp_replace(url, '/+$', ''))), 16) AS cache_key FROM pages")
def fn_hash_ids(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.short_id(F.col("url"), 12).alias("short_id"), text.cache_key(F.col("url")).alias("cache_key"))


@query("""SELECT page_id, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1, 1), h[18:20], '-', h[21:32]) AS uuid
 FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""")
def fn_url_uuid(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.url_uuid(F.col("url")).alias("uuid"))


HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(f"SELECT page_id, regexp_replace({HOST}, '^www\\.', '') AS domain, CASE WHEN regexp_matches(lower(url), '/(feed|rss)(/|$|\\.xml)') THEN 'feed' WHEN contains(lower(url), 'sitemap') THEN 'sitemap' ELSE 'page' END AS kind, regexp_matches(lower(url), '^https?://.') AS is_web FROM pages")
def fn_url_parts(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", urls.domain(u).alias("domain"), urls.kind(u).alias("kind"), urls.is_web(u).alias("is_web"))


@query("SELECT id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN concat(m::varchar, 'min') WHEN m < 1440 THEN concat((m // 60)::varchar, 'h') ELSE concat((m // 1440)::varchar, 'd') END AS label, strftime(created_at, '%H:%M') AS at FROM (SELECT id, created_at, (epoch(TIMESTAMP '2001-08-01' - created_at) // 60)::bigint AS m FROM cards)", CARDS)
def fn_relative_time(spark, sf):
    return cards(spark, sf).select("id", times.relative_label(F.col("created_at"), "2001-08-01 00:00:00").alias("label"), F.date_format("created_at", "HH:mm").alias("at"))


@query("""SELECT cards.id, greatest(1, least(10, CASE WHEN n >= 20 THEN 10 WHEN n >= 10 THEN 8 WHEN n >= 5 THEN 6 WHEN n >= 3 THEN 4 WHEN n >= 2 THEN 3 ELSE 1 END + CASE WHEN quality >= 0.7 THEN 1 WHEN quality < 0.4 THEN -1 ELSE 0 END - CASE WHEN is_press = 1 THEN 2 ELSE 0 END))::bigint AS level
 FROM cards LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON id = l_orderkey""", CARDS)
def fn_signal_level(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("n"))
    return cards(spark, sf).join(n, "id", "left").select("id", labels.signal_level(F.col("n"), F.col("quality"), F.col("is_press") == 1).cast("bigint").alias("level"))


def _run(a, b, t):
    return f"floor({a}::double + ({b} - {a}) * {t} + 0.5)::int"


def _rgb(a, b, t):
    return "concat('rgb(', " + ", ',', ".join(_run(x, y, t) for x, y in zip(a, b, strict=True)) + ", ')')"


@query(f"SELECT id, CASE WHEN s IS NULL THEN '#94a3b8' WHEN s < 0 THEN {_rgb(labels.BELOW, labels.NEUTRAL, '(-s)')} WHEN s <= 0.5 THEN {_rgb(labels.NEUTRAL, labels.HALF, '(s / 0.5::double)')} ELSE {_rgb(labels.HALF, labels.FULL, '((s - 0.5::double) / 0.5::double)')} END AS colour FROM (SELECT id, bias_signed AS s FROM cards)", CARDS)
def fn_colour(spark, sf):
    return cards(spark, sf).select("id", labels.bias_colour(F.col("bias_signed")).alias("colour"))


@query("SELECT c_custkey, lower(regexp_replace(trim(c_name), '\\s+', '-', 'g')) AS slug, concat(upper(c_mktsegment[1]), lower(c_mktsegment[2:])) AS label, upper(c_name[1]) AS initials FROM customer")
def fn_names(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"), text.capitalise(F.col("c_mktsegment")).alias("label"), text.initials(F.regexp_replace("c_name", r"\s.*", "")).alias("initials"))


@query("SELECT id, regexp_replace(summary, '(the|und)', '<mark>\\1</mark>', 'gi') AS marked, greatest(1, round(length(body) / 1200.0)::bigint) AS minutes FROM texts", TEXTS)
def fn_highlight(spark, sf):
    return texts(spark, sf).select("id", text.highlight(F.col("summary"), ["the", "und"]).alias("marked"), F.greatest(F.lit(1).cast("bigint"), F.round(F.length("body") / 1200.0).cast("bigint")).alias("minutes"))


# ---- lexicon scores


@query(f"SELECT id, {_ladder({k: _word_hits(v) for k, v in TOPICS.items()}, 'general')} AS topic FROM texts", TEXTS)
def txt_category(spark, sf):
    return texts(spark, sf).select("id", lexicon.category(F.col("body"), TOPICS, "general").alias("topic"))


@query(f"SELECT id, {_ladder({k: _phrase_hits(v) for k, v in TOPICS.items()}, 'general')} AS topic FROM texts", TEXTS)
def txt_category_contains(spark, sf):
    return texts(spark, sf).select("id", lexicon.category(F.col("body"), TOPICS, "general", words=False).alias("topic"))


@query("SELECT id, CASE WHEN contains(t, 'the') THEN 'east' WHEN contains(t, 'die') THEN 'west' WHEN contains(t, 'que') THEN 'south' ELSE 'general' END AS topic FROM (SELECT id, translate(lower(title), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc') AS t FROM texts)", TEXTS)
def txt_title_ladder(spark, sf):
    return texts(spark, sf).select("id", lexicon.title_ladder(F.col("title"), [("the", "east"), ("die", "west"), ("que", "south")], "general").alias("topic"))


@query(f"SELECT id, round(coalesce((p - a)::double / nullif(p + a, 0), 0), 3) AS polarity FROM (SELECT id, {_word_hits(PRO)} AS p, {_word_hits(ANTI)} AS a FROM texts)", TEXTS)
def txt_polarity(spark, sf):
    return texts(spark, sf).select("id", lexicon.polarity(F.col("body"), PRO, ANTI).alias("polarity"))


@query(f"""SELECT id, round(sign(net)::double * least(0.9::double, 0.1::double + abs(net) * 0.15::double), 2) AS polarity FROM (SELECT id, len(list_filter(w, lambda x: list_contains({_sql_list(PRO)}, x))) - len(list_filter(w, lambda x: list_contains({_sql_list(ANTI)}, x))) AS net
 FROM (SELECT id, string_split({BODY}, ' ') AS w FROM texts))""", TEXTS)
def txt_token_polarity(spark, sf):
    return texts(spark, sf).select("id", lexicon.token_polarity(F.col("body"), PRO, ANTI).alias("polarity"))


FUSION_SQL = f"""SELECT id, round(score, 4) AS score, CASE WHEN score < 0.25 THEN 'left' WHEN score < 0.42 THEN 'centre-left' WHEN score < 0.58 THEN 'centre' WHEN score < 0.75 THEN 'centre-right' ELSE 'right' END AS side FROM
 (SELECT id, (0.5::double * prior + CASE WHEN n > 0 THEN 0.35::double * (r::double / n) ELSE 0 END + coalesce(0.15::double * entity, 0)) / (0.5::double + CASE WHEN n > 0 THEN 0.35::double ELSE 0 END + CASE WHEN entity IS NOT NULL THEN 0.15::double ELSE 0 END) AS score FROM
 (SELECT id, CASE WHEN contains(source_name, 'src1') THEN 0.7::double WHEN contains(source_name, 'src2') THEN 0.3::double ELSE 0.5::double END AS prior, {_phrase_hits(RIGHT)} AS r, {_phrase_hits(RIGHT)} + {_phrase_hits(LEFT)} AS n,
 ({' + '.join(f"CASE WHEN {_phrase_hits([k])} > 0 THEN {v}::double ELSE 0 END" for k, v in NAMES.items())}) / nullif({' + '.join(f"CASE WHEN {_phrase_hits([k])} > 0 THEN 1 ELSE 0 END" for k in NAMES)}, 0) AS entity FROM texts))"""


@query(FUSION_SQL, TEXTS)
def txt_framing_fusion(spark, sf):
    b = F.col("body")
    parts = texts(spark, sf).select("id", lexicon.source_prior(F.col("source_name"), REGISTRY).alias("prior"), lexicon.framing(b, RIGHT, LEFT).alias("framing"), lexicon.entity_score(b, NAMES).alias("entity"))
    prior = F.when(F.col("prior.confidence") > 0.2, F.col("prior.score"))
    score = lexicon.fused([(prior, 0.5), (F.when(F.col("framing.n") > 0, F.col("framing.score")), 0.35), (F.col("entity"), 0.15)])
    return parts.select("id", score.alias("exact")).select("id", F.round("exact", 4).alias("score"), lexicon.side(F.col("exact")).alias("side"))


@query(f"SELECT id, o > n AND o >= 2 AS is_opinion, least(1, (o + n) / 5.0)::double AS confidence FROM (SELECT id, {_phrase_hits(OPINION)} AS o, {_phrase_hits(NEWS)} AS n FROM texts)", TEXTS)
def txt_opinion(spark, sf):
    return texts(spark, sf).select("id", lexicon.opinion(F.col("body"), OPINION, NEWS).alias("x")).select("id", "x.is_opinion", "x.confidence")


# ---- validity and quality


@query("""SELECT id, round(greatest(0, least(1, 0.7::double - CASE WHEN length(title) < 30 THEN 0.15::double WHEN length(title) > 80 THEN 0.05::double ELSE 0 END + CASE WHEN length(summary) < 50 THEN -0.25::double WHEN length(summary) > 300 THEN 0.1::double ELSE 0 END
 + CASE WHEN category IN ('en') THEN 0.05::double WHEN category IN ('de') THEN -0.1::double ELSE 0 END - CASE WHEN coalesce(press_flag = 1, false) THEN 0.35::double ELSE 0 END)), 2) AS quality FROM texts""", TEXTS)
def txt_quality_v1(spark, sf):
    press = F.coalesce(F.col("press_flag") == 1, F.lit(False))
    return texts(spark, sf).select("id", scoring.quality_by_shape(F.col("title"), F.col("summary"), F.col("category"), F.lit(0.0), press, ["en"], ["de"]).alias("quality"))


@query("SELECT id, round(least(1, 0.5::double + CASE WHEN length(body) > 2000 THEN 0.2::double WHEN length(body) > 500 THEN 0.1::double ELSE 0 END + CASE WHEN source_name <> '' THEN 0.15::double ELSE 0 END + CASE WHEN summary <> '' THEN 0.05::double ELSE 0 END + CASE WHEN coalesce(quality_flag, 0) < 0.3 THEN 0.1::double ELSE 0 END), 2) AS quality FROM texts", TEXTS)
def txt_quality_v2(spark, sf):
    return texts(spark, sf).select("id", scoring.quality_by_parts(F.col("body"), F.col("source_name"), F.col("summary"), F.col("quality_flag").cast("double")).alias("quality"))


@query("SELECT id, CASE WHEN body IS NULL OR length(body) < 100 THEN 0.2::double WHEN regexp_matches(body, '(?i)worthless|pathetic') THEN 0.1::double WHEN length(body) > 500 THEN 0.8::double ELSE 0.5::double END AS quality FROM texts", TEXTS)
def txt_quality_v3(spark, sf):
    return texts(spark, sf).select("id", scoring.quality_by_body(F.col("body"), "worthless|pathetic").alias("quality"))


@query("SELECT id, length(trim(title)) >= 5 AND (length(trim(summary)) >= 20 OR length(trim(body)) >= 100) AS valid, regexp_matches(body, '(?i)404 not found|access denied|lorem ipsum|\\||%%%') AS is_error FROM texts", TEXTS)
def txt_valid_items(spark, sf):
    return texts(spark, sf).select("id", scoring.is_valid(F.col("title"), F.lit("http://x"), F.col("summary"), F.col("body")).alias("valid"), scoring.matches_any(F.col("body"), ERRORS).alias("is_error"))


REJECT_SQL = "CASE WHEN regexp_matches(body, '(?i)[#$%&*]{3}') THEN 'symbols' WHEN regexp_matches(body, '(?i) \\| ') THEN 'table' WHEN regexp_matches(body, '(?i)worthless|pathetic') THEN 'insult' WHEN regexp_matches(body, '(?i)password|token') THEN 'secret' END"


@query(f"SELECT id, CASE WHEN length(body) < 60 THEN 'short' WHEN {REJECT_SQL} IS NOT NULL THEN {REJECT_SQL} WHEN row_number() OVER (PARTITION BY md5(body) ORDER BY id) > 1 THEN 'duplicate' END AS reason FROM texts", TEXTS)
def txt_reject_reason(spark, sf):
    """Copies are told by the smallest id of a digest, an aggregate, so many copies of one text do not meet in a task."""
    t = texts(spark, sf).select("id", "body", F.md5("body").alias("digest"))
    first = t.groupBy("digest").agg(F.min("id").alias("first_id"))
    reason = F.when(F.length("body") < 60, "short").otherwise(scoring.rejection(F.col("body"), FAMILIES))
    judged = t.select("id", "digest", reason.alias("reason"))
    return judged.join(first, "digest").select("id", F.coalesce("reason", F.when(F.col("id") > F.col("first_id"), "duplicate")).alias("reason"))


# ---- search


def bm25_sql(terms) -> str:
    tf = lambda t: f"len(list_filter(w, lambda x: x = '{t}'))"
    counts = ", ".join(f"{tf(t)} AS tf{i}" for i, t in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (tf{i} > 0) OVER () AS df{i}" for i in range(len(terms)))
    part = lambda i: f"ln(1 + (n - df{i} + 0.5::double) / (df{i} + 0.5::double)) * (tf{i} * 2.2::double) / (tf{i} + 1.2::double * (0.25::double + 0.75::double * len / mean))"
    every = " AND ".join(f"tf{i} > 0" for i in range(len(terms)))
    return f"SELECT id, round({' + '.join(part(i) for i in range(len(terms)))}, 4) AS score FROM (SELECT *, count(*) OVER () AS n, avg(len) OVER () AS mean, {stats} FROM (SELECT id, len(w) AS len, {counts} FROM (SELECT id, string_split({BODY}, ' ') AS w FROM texts))) WHERE {every}"


@query(bm25_sql(["the", "with"]), TEXTS)
def txt_search_bm25(spark, sf):
    return search.bm25(texts(spark, sf).select("id", F.col("body").alias("text")), ["the", "with"])


@query(f"SELECT id, score FROM ({bm25_sql(['die', 'und'])}) ORDER BY score DESC, id LIMIT 20", TEXTS)
def txt_search_top(spark, sf):
    return search.bm25(texts(spark, sf).select("id", F.col("body").alias("text")), ["die", "und"], most=20)


@query(f"""WITH {TEXTS}, w AS (SELECT id, list_filter(string_split({BODY}, ' '), lambda x: x <> '') AS ws FROM texts), lens AS (SELECT id, len(ws) AS len FROM w), stats AS (SELECT count(*) AS n, avg(len) AS mean FROM lens),
 tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(ws) AS term FROM w) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 asked AS (SELECT id AS query_id, tf.term, df FROM tf JOIN df ON tf.term = df.term WHERE id % 50 = 0 AND df >= 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY df, tf.term) <= 2),
 hits AS (SELECT query_id, tf.id, count(*) AS held, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * (tf * 2.2::double) / (tf + 1.2::double * (0.25::double + 0.75::double * len / mean))) AS score FROM asked JOIN tf ON asked.term = tf.term JOIN lens ON tf.id = lens.id, stats GROUP BY 1, 2)
 SELECT query_id, id, round(score, 4) AS score FROM hits WHERE held = (SELECT count(*) FROM asked a WHERE a.query_id = hits.query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, id) <= 10""")
def txt_search_index(spark, sf):
    """Searches of an index: every 50th text asks for its two rarest words; half of the texts were added after the index had been written."""
    docs = texts(spark, sf).select("id", F.col("body").alias("text"))
    index = textindex.TextIndex(spark, f"{shared_folder(spark)}/words-{uuid.uuid4().hex}")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for part in (half, ~half):
        index.append(docs.filter(part))
    return index.search(index.rarest_terms(docs.filter("id % 50 = 0"), 2), 10)


# ---- facts

ARTICLES = "articles AS (SELECT source AS cluster_id, doc_id AS id, ((doc_id * 37) % 201 - 100)::double / 100 AS bias, text FROM documents)"
SENTENCES = "sentences AS (SELECT cluster_id, id, bias, position, sentence, left(" + NORM.format("sentence") + ", 80) AS key FROM (SELECT cluster_id, id, bias, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS position FROM (SELECT cluster_id, id, bias, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 10) AS s FROM articles)))"
FACTS = "facts AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY frequency DESC, key) AS rank FROM (SELECT cluster_id, key, count(*) AS frequency, arg_min(sentence, (id, position)) AS sentence, round(min(bias), 4) AS bias_min, round(max(bias), 4) AS bias_max, round(avg(bias), 4) AS bias_avg FROM sentences WHERE key <> '' GROUP BY 1, 2))"


def _articles(spark, sf):
    return table(spark, sf, "documents").select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("id"), (((F.col("doc_id") * 37) % 201 - 100).cast("double") / 100).alias("bias"), "text")


@query("SELECT cluster_id, id, position::bigint AS position, key FROM sentences WHERE key <> ''", ARTICLES, SENTENCES)
def facts_sentences(spark, sf):
    return facts.sentence_rows(_articles(spark, sf)).select("cluster_id", "id", F.col("position").cast("bigint").alias("position"), "key")


@query("SELECT cluster_id, key, frequency, sentence, bias_min, bias_max, bias_avg, rank, CASE WHEN frequency >= 3 THEN 'verified' ELSE 'disputed' END AS status FROM facts WHERE rank <= 20", ARTICLES, SENTENCES, FACTS)
def facts_classified(spark, sf):
    return facts.facts(facts.sentence_rows(_articles(spark, sf)))


@query("SELECT doc_id, array_to_string(list_slice(list_sort(list_distinct(list_concat(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*'), regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')))), 1, 10), ';') AS entities FROM documents")
def facts_entities(spark, sf):
    patterns = {"number": r"[0-9]+(?:[.,][0-9]+)*", "name": "[A-Z][a-z]+ [A-Z][a-z]+"}
    return table(spark, sf, "documents").select("doc_id", F.array_join(facts.entities(F.col("text"), patterns), ";").alias("entities"))


BAND = "CASE WHEN bias > 0.3 THEN 'official' WHEN bias < -0.3 THEN 'opposition' ELSE 'neutral' END"


@query(f"""SELECT a.cluster_id, a.band, a.n, a.mean_bias, coalesce(leads, '') AS leads FROM (SELECT cluster_id, {BAND} AS band, count(*) AS n, round(avg(bias), 4) AS mean_bias FROM articles GROUP BY 1, 2) a LEFT JOIN
 (SELECT cluster_id, band, string_agg(sentence, ' / ' ORDER BY id) AS leads FROM (SELECT cluster_id, {BAND} AS band, id, sentence, row_number() OVER (PARTITION BY cluster_id, {BAND} ORDER BY id) AS rn FROM sentences WHERE position = 0) WHERE rn <= 3 GROUP BY 1, 2) b ON a.cluster_id = b.cluster_id AND a.band = b.band""", ARTICLES, SENTENCES)
def facts_perspectives(spark, sf):
    return facts.perspectives(_articles(spark, sf))


#: A cluster of its own for every document shows what is told where no fact is verified.
ALONE = "SELECT cluster_id, id, bias, left(text, 280) AS summary FROM articles WHERE text IS NOT NULL UNION ALL SELECT concat(cluster_id, '-', lang, '-', (id % 7)::varchar), id, bias, left(articles.text, 280) FROM articles JOIN documents ON doc_id = id WHERE articles.text IS NOT NULL"


@query(f"""WITH told AS ({ALONE}), calm AS (SELECT cluster_id, string_agg(summary, ' | ' ORDER BY bias, id) AS spared FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY bias, id) AS rn FROM told WHERE abs(bias) < 0.2) WHERE rn <= 3 AND summary <> '' GROUP BY 1),
 per AS (SELECT cluster_id, arg_min(id, (bias, id)) FILTER (abs(bias) < 0.2) AS neutral_id, count(*) AS n, list(id ORDER BY bias, id)[count(*) // 2 + 1] AS middle_id FROM told GROUP BY 1), f AS (SELECT cluster_id, string_agg(sentence, '. ' ORDER BY rank) AS summary FROM facts WHERE rank <= 5 AND frequency >= 3 GROUP BY 1)
 SELECT per.cluster_id, coalesce(neutral_id, middle_id) AS base_id, n, left(trim(regexp_replace(coalesce(f.summary, spared, told.summary, ''), '<[^>]+>', '', 'g')), 1000) AS summary FROM per LEFT JOIN f ON per.cluster_id = f.cluster_id LEFT JOIN calm ON per.cluster_id = calm.cluster_id LEFT JOIN told ON per.cluster_id = told.cluster_id AND coalesce(neutral_id, middle_id) = told.id""", ARTICLES, SENTENCES, FACTS)
def facts_fallback(spark, sf):
    """Clusters by source, whose facts are known, and smaller ones by source, language and number, of which none is."""
    a = _articles(spark, sf).filter("text is not null")
    told = a.withColumn("summary", F.left("text", F.lit(280)))
    small = told.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    small = small.withColumn("cluster_id", F.concat_ws("-", "cluster_id", "lang", (F.col("id") % 7).cast("string"))).select(told.columns)
    return facts.fallback(told.unionByName(small), facts.facts(facts.sentence_rows(_articles(spark, sf))))


# ---- clusters and vectors

SIGNED = f"signed AS (SELECT id, array_to_string(list_sort(list_slice(list_sort(list_transform(list_distinct({SIG_WORDS.format(TITLE)}), lambda w: (-length(w), w))), 1, 6).list_transform(lambda x: x[2])), '|') AS signature FROM texts)"
SETS = f"sets AS (SELECT words, min(id) AS set_id FROM (SELECT id, list_sort(list_distinct({SIG_WORDS.format(TITLE)})) AS words FROM texts) WHERE len(words) > 0 GROUP BY words)"
EDGES = "edges AS (SELECT a, b, round(c::double / (na + nb - c), 4) AS score FROM (SELECT x.set_id AS a, y.set_id AS b, len(list_intersect(x.words, y.words)) AS c, len(x.words) AS na, len(y.words) AS nb FROM sets x JOIN sets y ON x.set_id < y.set_id) WHERE round(c::double / (na + nb - c), 4) >= 0.5)"


@query("SELECT id, left(md5(signature), 12) AS cluster_id FROM signed WHERE signature <> '' AND signature IN (SELECT signature FROM signed GROUP BY 1 HAVING count(*) >= 2)", TEXTS, SIGNED)
def clu_signature(spark, sf):
    return clusters.by_signature(texts(spark, sf).select("id", "title"))


WHOLE_SIGNATURE = SIG_WORDS.format(NORM.format("coalesce(text, '')"))


@query(f"SELECT id, left(md5(signature), 12) AS cluster_id FROM (SELECT *, count(*) OVER (PARTITION BY signature) AS n FROM (SELECT doc_id AS id, array_to_string(list_sort(list_slice(list_sort(list_transform(list_distinct({WHOLE_SIGNATURE}), lambda w: (-length(w), w))), 1, 6).list_transform(lambda x: x[2])), '|') AS signature FROM documents)) WHERE n >= 2 AND signature <> ''")
def clu_text_signature(spark, sf):
    """Documents whose whole texts have the same longest words."""
    return clusters.by_signature(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("title")))


def _titles(spark, sf):
    return texts(spark, sf).select("id", "title")


@query("SELECT a, b, score FROM edges", TEXTS, SETS, EDGES)
def clu_jaccard_edges(spark, sf):
    return clusters.similar_sets(clusters.word_sets(_titles(spark, sf)))


@query(f"WITH RECURSIVE {TEXTS}, {SETS}, {EDGES}, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(id, root) AS (SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON r.root = e.a) SELECT id, min(root) AS root FROM reach GROUP BY id")
def clu_components(spark, sf):
    return clusters.components(clu_jaccard_edges(spark, sf))


@query()
def clu_greedy(spark, sf):
    """Batches of 500 ids, as the incremental job takes them."""
    batched = texts(spark, sf).select(F.floor(F.col("id") / 500).alias("batch"), "id", "title")
    return clusters.greedy(batched)


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


COS = "(list_dot_product(q.embedding::double[], v.embedding::double[]) / (sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(v.embedding::double[], v.embedding::double[])) + 1e-9))"


@query(f"SELECT query_id, id, round(score, 4) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({COS}, 9) DESC, v.vec_id) AS rn FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE rn <= 10")
def vec_cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return vectors.vector_scores(v.filter("id % 50 = 0"), v, k=10).select("query_id", "id", F.round("score", 4).alias("score"))


@query(f"SELECT query_id, id, round(score, 4) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id AS id, {COS} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0) WHERE score >= 0.3")
def vec_links(spark, sf):
    v = _vectors(spark, sf)
    return vectors.vector_scores(v.filter("id % 50 = 0"), v, least=0.3).select("query_id", "id", F.round("score", 4).alias("score"))


@query()
def vec_index_topk(spark, sf):
    """The same from an index of cells, with as many probes as a sample asks for; tests measure how many of the ten it finds."""
    v = _vectors(spark, sf)
    index = vectors.CellIndex.build(v, f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}")
    return index.search(v.filter("id % 50 = 0"), 10).select("query_id", "id", F.round("score", 4).alias("score"))


@query(ORACLES["vec_cosine_topk"])
def vec_index_exact(spark, sf):
    """The index with all cells probed, half of its vectors appended after it was built: exact."""
    v = _vectors(spark, sf)
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    index = vectors.CellIndex.build(v.filter(half), f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}")
    index.append(v.filter(~half))
    return index.search(v.filter("id % 50 = 0"), 10, probes=len(index.centres)).select("query_id", "id", F.round("score", 4).alias("score"))


PROTO = "protos AS (SELECT label, [" + ", ".join(f"avg(embedding[{i}]::double)" for i in range(1, 65)) + "] AS embedding FROM embeddings GROUP BY label)"


@query(f"SELECT id, arg_max(label, (round(score, 6), -label)) AS label, round(max(round(score, 6)), 4) AS score FROM (SELECT v.vec_id AS id, q.label, {COS} AS score FROM embeddings v, protos q) GROUP BY id", PROTO)
def vec_prototype_label(spark, sf):
    v = _vectors(spark, sf)
    return search.nearest_label(v.select("id", "vector"), search.prototypes(v, "label", 64))


# ---- pages

HREFS = "regexp_extract_all(html, '(?i)<a\\s[^>]*href=[\"'']([^\"'']+)[\"'']', 1)"


@query(f"SELECT page_id, len({HREFS})::bigint AS n_links, len(list_distinct({HREFS}))::bigint AS n_distinct, {HREFS}[1] AS first_link FROM pages")
def html_links(spark, sf):
    found = table(spark, sf, "pages").select("page_id", markup.links(F.col("html")).alias("found"))
    return found.select("page_id", F.size("found").cast("bigint").alias("n_links"), F.size(F.array_distinct("found")).cast("bigint").alias("n_distinct"), F.get("found", F.lit(0)).alias("first_link"))


ENT = "{0}"
for _e, _p in text.ENTITIES:
    ENT = f"replace({ENT}, '{_e}', '" + _p.replace("'", "''") + "')"


@query(f"SELECT page_id, {ENT.format('nullif(trim(regexp_extract(html, ' + chr(39) + '(?is)<title(?:\\s[^>]*)?>(.*?)</title>' + chr(39) + ', 1)), ' + chr(39) * 2 + ')')} AS title FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.unescape(markup.first_tag(F.col("html"), "title")).alias("title"))


@query("SELECT page_id, regexp_matches(html, '(?i)<article') AS has_article, regexp_matches(html, '(?i)<main') AS has_main, regexp_matches(html, '(?i)<nav') AS has_nav, regexp_matches(html, '(?i)<script') AS has_script, regexp_matches(html, '(?i)wp-content|wp-json') AS is_wordpress FROM pages")
def html_sniff(spark, sf):
    marks = markup.sniff(F.col("html"))
    return table(spark, sf, "pages").select("page_id", *[marks[k].alias(k) for k in ("has_article", "has_main", "has_nav", "has_script", "is_wordpress")])


# ---- text sinks


@query("SELECT concat('<url><loc>https://news.example/', lower(regexp_replace(n_name, '\\s+', '-', 'g')), '</loc></url>') AS entry FROM nation")
def txt_sitemap(spark, sf):
    return table(spark, sf, "nation").select(F.format_string("<url><loc>https://news.example/%s</loc></url>", text.slug(F.col("n_name"))).alias("entry"))


@query("SELECT concat('events_total{type=\"', event_type, '\"} ', count(*)::varchar) AS line FROM events GROUP BY event_type")
def txt_metrics(spark, sf):
    return rel.counts_by(table(spark, sf, "events"), "event_type").select(F.format_string('events_total{type="%s"} %d', F.col("event_type"), F.col("n")).alias("line"))


@query("SELECT id, concat(trim(title), ' - ', source_name) AS message FROM texts", TEXTS)
def txt_share(spark, sf):
    return texts(spark, sf).select("id", F.format_string("%s - %s", F.trim("title"), F.col("source_name")).alias("message"))
