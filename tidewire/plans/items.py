"""Items from feeds, sitemaps, posts and pages, and what is derived from their texts.

The tables hold no fetched feeds, so bodies are written from the columns of ``pages`` and parsed
back; the SQL starts from the columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import facts, ingest, lexicon, scoring
from tidewire.operators import relational as rel
from tidewire.plans import ORACLES, TEXTS, query
from tidewire.plans.content import ENT, FAMILIES, HOST, NAMES, PRO, REGISTRY, REJECT_SQL, RIGHT, LEFT, _phrase_hits, _sql_list
from tidewire.sources import bodies, connectors, markup
from tidewire.sources.roles import table, texts
from tidewire.streaming.streams import drained, shared_folder

RAW_TITLE = "trim(regexp_extract(html, '(?is)<title(?:\\s[^>]*)?>(.*?)</title>', 1))"
TITLE_OF = ENT.format(RAW_TITLE)
DOMAIN_OF = f"regexp_replace({HOST}, '^www\\.', '')"
#: When a page came: a minute each.
CAME = "TIMESTAMP '2024-01-01' + to_minutes(page_id::int)"
KIND = "CASE WHEN url LIKE 'https:%' THEN 'a' WHEN url LIKE '%.org%' THEN 'b' ELSE 'c' END"


def _pages(spark, sf):
    came = F.expr("timestampadd(MINUTE, page_id, timestamp_ntz'2024-01-01')")
    raw = F.trim(F.regexp_extract("html", r"(?is)<title(?:\s[^>]*)?>(.*?)</title>", 1))
    return table(spark, sf, "pages").select("page_id", "url", "html", raw.alias("raw_title"), came.alias("came"), urls.domain(F.col("url")).alias("domain"))


def _rss(spark, sf):
    """One RSS body per page."""
    item = "<?xml version=\"1.0\"?><rss><channel><title>x</title><item><title><![CDATA[%s]]></title><link>%s</link><description>%s</description><enclosure type=\"image/png\" url=\"%s/p.png\"/><pubDate>%s</pubDate></item><item><title>no link</title></item></channel></rss>"
    p = _pages(spark, sf)
    body = F.format_string(item, F.col("raw_title"), F.col("url"), markup.xml_escaped(F.concat(F.lit("<b>"), F.col("domain"), F.lit("</b> tells"))), F.col("url"), F.date_format("came", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
    return p.select(F.col("page_id").alias("feed_id"), body.alias("body"))


@query(f"SELECT page_id AS feed_id, 0::bigint AS position, {TITLE_OF} AS title, url, concat({DOMAIN_OF}, ' tells') AS summary, concat(url, '/p.png') AS image_url, {CAME} AS published_at FROM pages WHERE {RAW_TITLE} <> ''")
def feed_rss_items(spark, sf):
    rows = markup.rss_items(_rss(spark, sf))
    return rows.withColumns({"position": F.col("position").cast("bigint"), "published_at": F.col("published_at").cast("timestamp_ntz")})


def _left_by_fetcher(spark, sf) -> str:
    """The RSS bodies as a folder of files, as a fetcher leaves them."""
    folder = f"{shared_folder(spark)}/bodies-{uuid.uuid4().hex}"
    feeds = _rss(spark, sf)
    feeds.select(F.col("feed_id").alias("id"), F.lit("http://fetched/").alias("url"), F.lit("rss").alias("kind"), "body").write.json(folder)
    bodies.register(spark)
    return folder


def _parsed(rows):
    found = markup.rss_items(rows.filter("kind = 'rss'").select(F.col("id").alias("feed_id"), "body"))
    return found.withColumns({"position": F.col("position").cast("bigint"), "published_at": F.col("published_at").cast("timestamp_ntz")})


@query(ORACLES["feed_rss_items"])
def src_bodies(spark, sf):
    """The same from files of bodies, read as a data source."""
    return _parsed(spark.read.format("bodies").load(_left_by_fetcher(spark, sf)))


@query(ORACLES["feed_rss_items"])
def stream_bodies(spark, sf):
    """The same as a stream of the folder's files."""
    rows = spark.readStream.format("bodies").load(_left_by_fetcher(spark, sf))
    return drained(_parsed(rows), "append", shared_folder(spark))


@query(f"SELECT url, published_at FROM (SELECT url, came AS published_at, min(came) OVER (PARTITION BY domain) AS first_at, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM (SELECT *, {CAME} AS came, {DOMAIN_OF} AS domain FROM pages WHERE {RAW_TITLE} <> '')) WHERE rn = 1 AND published_at > first_at - INTERVAL 1 HOUR AND published_at <> first_at")
def feed_rss_delta(spark, sf):
    """Items above their domain's mark less an hour, each URL once, without the item that set the mark."""
    rows = markup.rss_items(_rss(spark, sf)).select(urls.domain(F.col("url")).alias("domain"), "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))
    marks = rows.groupBy("domain").agg(F.min("published_at").alias("mark"))
    fresh = ingest.above_mark(rows.groupBy("domain", "url").agg(F.min("published_at").alias("published_at")), marks, "domain", "published_at", "1 HOUR")
    return fresh.join(marks, "domain").filter("published_at <> mark").select("url", "published_at")


@query(f"SELECT page_id AS feed_id, {TITLE_OF} AS title, url, {DOMAIN_OF} AS summary, {CAME} AS published_at FROM pages WHERE {RAW_TITLE} <> ''")
def feed_atom_items(spark, sf):
    form = "<feed><entry><title>%s</title><link rel=\"alternate\" href=\"%s\"/><summary>%s</summary><updated>%s</updated></entry></feed>"
    p = _pages(spark, sf)
    body = F.format_string(form, F.col("raw_title"), F.col("url"), F.col("domain"), F.date_format("came", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rows = markup.atom_items(p.select(F.col("page_id").alias("feed_id"), body.alias("body")))
    return rows.select("feed_id", "title", "url", "summary", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


LAST_PART = "replace(replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/?$', 1), '.html', ''), '-', ' ')"


@query(f"SELECT page_id AS map_id, url, array_to_string(list_transform(string_split({LAST_PART}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') AS title FROM pages")
def feed_sitemap_urls(spark, sf):
    body = F.format_string("<urlset><url>\n <loc> %s </loc><lastmod>2024-01-01</lastmod></url></urlset>", markup.xml_escaped(F.col("url")))
    maps = table(spark, sf, "pages").select(F.col("page_id").alias("map_id"), body.alias("body"))
    return markup.sitemap_urls(maps).select("map_id", "url", "title")


@query(f"SELECT page_id AS site_id, {TITLE_OF} AS title, url, concat(url, '/p.png') AS image_url, {CAME} AS published_at FROM pages")
def feed_posts(spark, sf):
    p = _pages(spark, sf)
    struct = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    media = F.struct(F.array(struct(source_url=F.concat("url", F.lit("/p.png")))).alias("wp:featuredmedia"))
    post = struct(link=F.col("url"), date_gmt=F.date_format("came", "yyyy-MM-dd'T'HH:mm:ss"), title=struct(rendered=F.concat(F.lit("<i>"), F.col("raw_title"), F.lit("</i>"))), excerpt=struct(rendered=F.lit("<p>x</p>")), _embedded=media)
    rows = markup.posts(p.select(F.col("page_id").alias("site_id"), F.to_json(F.array(post)).alias("body")))
    return rows.select("site_id", "title", "url", "image_url", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(f"SELECT page_id AS id, url, CASE WHEN {TITLE_OF} <> '' THEN {TITLE_OF} ELSE array_to_string(list_transform(string_split({LAST_PART}, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ') END AS title, left(html, 500) AS summary, strlen(left(html, 3000))::bigint AS n_bytes FROM pages WHERE html <> ''")
def feed_reader_replies(spark, sf):
    reply = F.to_json(F.struct(F.struct(text.unescape(F.col("raw_title")).alias("title"), F.col("html").alias("content")).alias("data")))
    rows = markup.reader_reply(_pages(spark, sf).select(F.col("page_id").alias("id"), "url", reply.alias("body")))
    return rows.select("id", "url", "title", "summary", F.octet_length("text").cast("bigint").alias("n_bytes"))


SHOWN = ENT.format("regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')")
WHOLE = f"trim(regexp_replace({SHOWN}, '\\s+', ' ', 'g'))"
HEADING = ENT.format("trim(regexp_extract(html, '(?is)<h1(?:\\s[^>]*)?>(.*?)</h1>', 1))")


@query(f"SELECT page_id, title, left(whole, 3000) AS text, length(whole)::bigint AS n_chars FROM (SELECT page_id, CASE WHEN {RAW_TITLE} <> '' THEN {TITLE_OF} ELSE {HEADING} END AS title, {WHOLE} AS whole FROM pages) WHERE title <> '' AND length(whole) >= 50")
def html_article(spark, sf):
    return markup.article(table(spark, sf, "pages"))


ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
USUAL = "[" + ", ".join(f"concat({ROOT}, '{p}')" for p in markup.FEED_PATHS) + "]"


FOLDER = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '')"
FEEDS = f"feeds AS (SELECT page_id, unnest(f) AS feed_url, unnest(t) AS feed_type, (generate_subscripts(f, 1) - 1)::bigint AS position FROM (SELECT page_id, CASE {KIND} WHEN 'a' THEN [concat({ROOT}, '/all.xml?a=1&b=2'), 'https://feeds.example/x', concat({FOLDER}, 'more.xml')] WHEN 'b' THEN [concat({FOLDER}, 'news/rss'), concat(regexp_extract(url, '^[a-z]+:'), '//cdn.example/f.xml')] ELSE {USUAL} END AS f, CASE {KIND} WHEN 'a' THEN ['rss', 'rss', 'rss'] WHEN 'b' THEN ['atom', 'rss'] ELSE [NULL, NULL, NULL, NULL, NULL, NULL]::varchar[] END AS t FROM pages))"


def _feeds(spark, sf):
    two = '<link rel="alternate" type="application/rss+xml" href="/all.xml?a=1&amp;b=2"><link href="https://feeds.example/x" type="text/xml"><link type="application/xml" href="/all.xml?a=1&b=2"><link type="application/xml" href="./sub/../more.xml">'
    one = '<link type="application/atom+xml" title="x" href="news/rss"><link type="text/xml" href="//cdn.example/f.xml">'
    named = F.when(F.startswith("url", F.lit("https:")), two).when(F.contains("url", F.lit(".org")), one).otherwise('<link rel="icon" type="image/png" href="/i.png">')
    rows = markup.discovered_feeds(table(spark, sf, "pages").withColumn("html", F.concat(named, "html")))
    return rows.withColumn("position", F.col("position").cast("bigint"))


@query("SELECT page_id, feed_url, feed_type, position FROM feeds", FEEDS)
def html_feeds(spark, sf):
    """Pages over https name three feeds, those of .org hosts two; the others are tried at the usual places."""
    return _feeds(spark, sf)


REPLY = "CASE WHEN left(md5(feed_url), 1) < '6' THEN 0 WHEN left(md5(feed_url), 1) < '8' THEN 1 ELSE 2 END"


@query(f"SELECT page_id, feed_url, position, k::bigint AS item, concat('Item ', k::varchar, ' of ', feed_url) AS title, concat(feed_url, '?i=', k::varchar, '&x=1') AS url FROM (SELECT *, unnest(range(3)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY position) AS rn FROM feeds WHERE {REPLY} = 2) WHERE rn = 1)", FEEDS)
def src_first_parse(spark, sf):
    """From a page's candidates to the items of the first that is a feed with items. What each address replies goes by a hash of it: a page, a feed without items, a feed."""
    feeds = _feeds(spark, sf)
    first = F.left(F.md5(F.col("feed_url").cast("binary")), F.lit(1))
    link = markup.xml_escaped(F.concat("feed_url", F.lit("?i=%d&x=1")))
    item = lambda k: F.format_string("<item><title>Item %d of %s</title><link>%s</link></item>", F.lit(k), markup.xml_escaped(F.col("feed_url")), F.replace(link, F.lit("%d"), F.lit(str(k))))
    body = F.when(first < "6", "<html>not found</html>").when(first < "8", "<rss><channel></channel></rss>").otherwise(F.concat(F.lit("<rss>"), *[item(k) for k in range(3)], F.lit("</rss>")))
    fetched = feeds.select("feed_url").distinct().select("feed_url", body.alias("body"), F.lit("text/html").alias("content_type"))
    found = connectors.first_parsed(feeds, fetched)
    return found.select("page_id", "feed_url", "position", F.col("item").cast("bigint").alias("item"), "title", "url")


#: A title as a feed tells it: without a CDATA section around it.
FEED_TITLE = ENT.format(f"trim(regexp_replace({RAW_TITLE}, '(?s)^\\s*<!\\[CDATA\\[(.*?)\\]\\]>\\s*$', '\\1'))")


# Titles begin anew with each item; a body holds all pages of a host, longest first by number.
@query(f"""SELECT host, (rn - 1)::bigint AS position, title, url, length(summary)::bigint AS n_summary FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id DESC) AS rn FROM (SELECT page_id, {HOST} AS host, {FEED_TITLE} AS title, concat(url, CASE WHEN contains(url, '#') THEN '' ELSE '?a=1&b=2' END) AS url, left(trim(regexp_replace(repeat(concat({TITLE_OF}, ' tells; '), 40), '<[^>]*>', '', 'g')), 500) AS summary FROM pages WHERE {RAW_TITLE} <> '')) WHERE rn <= 20 AND title <> ''""")
def feed_rss_many(spark, sf):
    """Feeds of all pages of a host: the first twenty items in the feed's order, summaries without tags and outer blanks, cut to 500 characters, links with references."""
    p = _pages(spark, sf).filter("raw_title != ''").withColumn("url", F.concat("url", F.when(F.contains("url", F.lit("#")), "").otherwise("?a=1&b=2")))
    summary = F.repeat(F.concat("raw_title", F.lit(" tells; ")), F.lit(40))
    item = F.format_string("<item><title>%s</title><link>%s</link><description>%s</description></item>", F.col("raw_title"), markup.xml_escaped(F.col("url")), summary)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("page_id")).alias("n"), item.alias("item"))))
    bodies_ = p.groupBy(urls.host(F.col("url")).alias("feed_id")).agg(F.concat(F.lit("<rss>"), F.array_join(F.transform(listed, lambda x: x["item"]), "\n"), F.lit("</rss>")).alias("body"))
    return markup.rss_items(bodies_).select(F.col("feed_id").alias("host"), F.col("position").cast("bigint").alias("position"), "title", "url", F.length("summary").cast("bigint").alias("n_summary"))


@query(r"""SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(lower(url), '/feed|/rss|\.xml|feedburner') OR contains(html, 'type="application/rss+xml"') OR contains(html, 'type="application/atom+xml"') THEN 'rss' END, CASE WHEN contains(html, 'wp-json') OR contains(html, 'WordPress') THEN 'wordpress' END, 'sitemap', CASE WHEN NOT regexp_matches(lower(url), '/feed|/rss|\.xml|/tag/|/category/') THEN 'article' END, 'reader') AS tried FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN concat(url, '/feed/x') WHEN page_id % 5 = 1 THEN concat(url, '/tag/x') ELSE url END AS url, CASE WHEN page_id % 3 = 0 THEN concat(html, '<link href="/wp-json/">') ELSE html END AS html FROM pages)""")
def src_capable(spark, sf):
    """The connectors that may be tried for a page, by its address and what it holds; some pages are given marks of both."""
    p = table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/feed/x"))).when(F.col("page_id") % 5 == 1, F.concat("url", F.lit("/tag/x"))).otherwise(F.col("url"))
    html = F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit('<link href="/wp-json/">'))).otherwise(F.col("html"))
    return p.select("page_id", F.array_join(connectors.capable(url, html), ",").alias("tried"))


PART = "trim(regexp_replace(" + ENT.format("regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>', 1), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"
PARTS = [PART.replace("{tag}", t) for t in ("article", "main", "body")]


@query("SELECT page_id, coalesce(" + ", ".join(f"CASE WHEN length({p}) > 200 THEN {p} END" for p in PARTS) + ", " + ", ".join(f"nullif({p}, '')" for p in PARTS) + ", '') AS text FROM pages")
def html_best_text(spark, sf):
    """The text of a rendered page: of article, main and body the first with more than 200 characters, else the first with any."""
    return table(spark, sf, "pages").select("page_id", F.coalesce(markup.rendered_text(F.col("html")), F.lit("")).alias("text"))


SELECTORS = {"containers": ["<article[^>]*>", "<div[^>]*class=\"[^\"]*(?:article|post|card)[^\"]*\"[^>]*>", "<div[^>]*class=\"[^\"]*ad[^\"]*\"[^>]*>"], "titles": ["<h[12][^>]*>", "<a[^>]*href=[^>]*>"], "dates": ["<time[^>]*>", "<meta[^>]*>"]}


def _selector_sql(patterns: list[str]) -> str:
    found = "list_transform(" + " || ".join(f"regexp_extract_all(html, '(?i){p}')" for p in patterns) + ", lambda t: left(t, 100))"
    return f"array_to_string(list_filter({found}, lambda t, i: list_position({found}, t) = i)[1:5], ' ')"


@query(f"SELECT page_id, {', '.join(f'{_selector_sql(v)} AS {k}' for k, v in SELECTORS.items())}, concat('made by ', page_id::varchar) AS generator FROM pages")
def html_selectors(spark, sf):
    """Tags that hold articles, titles and dates, and who made the page, which these pages are given to tell."""
    p = table(spark, sf, "pages")
    made = F.concat("html", F.lit('<meta name="x" content="y"><meta name="generator" content="made by '), F.col("page_id").cast("string"), F.lit('">'))
    return p.select("page_id", *[F.array_join(markup.selectors(F.col("html"), v), " ").alias(k) for k, v in SELECTORS.items()], markup.meta(made, "generator").alias("generator"))


@query("SELECT page_id, contains(lower(url), 'page') OR regexp_matches(html, '(?i)<rss|<feed|<rdf') AS is_feed FROM pages")
def html_feed_reply(spark, sf):
    """A reply is a feed by its content type (pages with a page number are given one) or by its root tag."""
    kind = F.when(F.contains(F.lower("url"), F.lit("page")), "application/rss+xml; charset=utf-8").otherwise("text/html")
    return table(spark, sf, "pages").select("page_id", markup.feed_reply(F.col("html"), kind).alias("is_feed"))


HANDLE = "left(md5(url), 8)"


@query(f"""SELECT page_id, target, CASE WHEN n = 0 THEN 'video' ELSE CASE WHEN n < 3 THEN 'social' ELSE 'page' END END AS kind, CASE n WHEN 0 THEN concat('https://www.youtube.com/oembed?url=', url_encode(target), '&format=json') WHEN 1 THEN concat('https://publish.twitter.com/oembed?url=', url_encode(target)) WHEN 2 THEN concat('https://www.tiktok.com/oembed?url=', url_encode(target)) END AS oembed,
 CASE WHEN n = 0 THEN 'video,rss' WHEN n < 3 THEN 'social,rss' ELSE 'rss,wordpress' END AS first_methods FROM (SELECT *, CASE n WHEN 0 THEN concat('https://www.youtube.com/watch?v=', h) WHEN 1 THEN concat('https://x.com/', h) WHEN 2 THEN concat('https://m.tiktok.com/@', h) ELSE url END AS target FROM (SELECT page_id, url, {HANDLE} AS h, CASE WHEN url LIKE 'https:%' THEN CASE WHEN url LIKE '%.com%' THEN 0 ELSE 1 END WHEN url LIKE '%.org%' THEN 2 ELSE 3 END AS n FROM pages))""")
def fn_oembed(spark, sf):
    """Where videos and posts are asked for; pages stand for one or the other by scheme and host."""
    u, h = F.col("url"), F.left(F.md5("url"), F.lit(8))
    secure = F.startswith(u, F.lit("https:"))
    target = F.when(secure & F.contains(u, F.lit(".com")), F.concat(F.lit("https://www.youtube.com/watch?v="), h)).when(secure, F.concat(F.lit("https://x.com/"), h)).when(F.contains(u, F.lit(".org")), F.concat(F.lit("https://m.tiktok.com/@"), h)).otherwise(u)
    rows = table(spark, sf, "pages").select("page_id", target.alias("target"))
    t = F.col("target")
    return rows.select("page_id", "target", urls.kind(t).alias("kind"), urls.oembed(t).alias("oembed"), F.array_join(F.slice(urls.methods(t), 1, 2), ",").alias("first_methods"))


@query("SELECT n_nationkey, concat('https://news.example/rss/search?q=', url_encode(concat(n_name, ' news \"', r_name, '\"')), '&hl=en') AS feed_url FROM nation JOIN region ON n_regionkey = r_regionkey")
def src_news_search(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    return n.select("n_nationkey", F.concat(F.lit("https://news.example/rss/search?q="), urls.encoded(F.format_string('%s news "%s"', F.col("n_name"), F.col("r_name"))), F.lit("&hl=en")).alias("feed_url"))


@query("SELECT event_id, concat('e', event_id::varchar) AS url, i::bigint AS position FROM (SELECT event_id, unnest(range(0, 3)) AS i FROM events) WHERE i <> 1")
def src_json_array(spark, sf):
    """Arrays of leads, one per event; entries without a URL are left out."""
    lead = lambda u: F.struct(u.alias("url"))
    body = F.to_json(F.array(lead(F.concat(F.lit("e"), F.col("event_id").cast("string"))), lead(F.lit(None).cast("string")), lead(F.concat(F.lit("e"), F.col("event_id").cast("string")))))
    rows = table(spark, sf, "events").select("event_id", F.posexplode(F.from_json(body, "array<struct<url:string>>")).alias("position", "lead"))
    return rows.filter("lead.url is not null").select("event_id", "lead.url", F.col("position").cast("bigint").alias("position"))


@query(f"SELECT domain, min(page_id) AS page_id, arg_min(path, (page_id, path)) AS path FROM (SELECT {DOMAIN_OF} AS domain, page_id, CASE WHEN url LIKE '%?%' THEN '/rss' ELSE '/feed' END AS path FROM pages WHERE url LIKE 'http:%') WHERE domain NOT IN (SELECT {DOMAIN_OF} FROM pages WHERE url LIKE 'https:%') GROUP BY 1")
def src_validated_candidates(spark, sf):
    """Candidates whose domain is new and that answer, with the first path that answers: /rss where there is a query, else /feed."""
    p = table(spark, sf, "pages").select("page_id", "url", urls.domain(F.col("url")).alias("domain"), F.when(F.startswith("url", F.lit("http:")), 200).otherwise(301).alias("status"))
    known = p.filter("status = 301").select("domain").distinct()
    answers = F.coalesce(F.when(F.contains("url", F.lit("?")), "/rss"), F.lit("/feed"))
    first = p.filter("status = 200").withColumn("path", answers).groupBy("domain").agg(F.min("page_id").alias("page_id"), F.min_by("path", F.struct("page_id", "path")).alias("path"))
    return rel.difference(first, known, "domain").select("domain", "page_id", "path")


@query(f"""WITH results AS (SELECT page_id, 1 AS rank, CASE WHEN url LIKE '%page%' THEN 0 ELSE 3 END AS n FROM pages WHERE url LIKE 'https:%' UNION ALL SELECT page_id, 2, 1 FROM pages WHERE url LIKE '%.org%' UNION ALL SELECT page_id, 5, CASE WHEN {RAW_TITLE} <> '' THEN 1 ELSE 0 END FROM pages)
 SELECT page_id, arg_min(CASE rank WHEN 1 THEN 'rss' WHEN 2 THEN 'wordpress' ELSE 'article' END, CASE WHEN rank = 5 AND page_id IN (SELECT doc_id FROM labels) THEN 0 ELSE rank END) AS connector FROM results WHERE n > 0 AND NOT (rank = 2 AND page_id IN (SELECT user_id FROM events WHERE event_type = 'error')) GROUP BY 1""")
def src_cascade(spark, sf):
    """Per page the first connector whose result is not empty: the learned one first, those with an open breaker skipped."""
    p = _pages(spark, sf)
    has = lambda c, n: F.when(c, n)
    results = p.select("page_id", F.explode(F.array(
        F.struct(F.lit("rss").alias("connector"), has(F.startswith("url", F.lit("https:")), F.when(F.contains("url", F.lit("page")), 0).otherwise(3)).alias("n_items")),
        F.struct(F.lit("wordpress").alias("connector"), has(F.contains("url", F.lit(".org")), F.lit(1)).alias("n_items")),
        F.struct(F.lit("article").alias("connector"), has(F.lit(True), F.when(F.col("raw_title") != "", 1).otherwise(0)).alias("n_items")),
    )).alias("r")).select("page_id", "r.*")
    learned = table(spark, sf, "labels").select(F.col("doc_id").alias("page_id"), F.lit("article").alias("learned")).distinct()
    open_ = table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("page_id"), F.lit("wordpress").alias("connector")).distinct()
    return connectors.first_result(results, "page_id", learned, open_).select("page_id", "connector")


# ---- texts


@query("""SELECT id, CASE WHEN out = '' THEN body WHEN length(out) < length(body) AND length(out) > 50 THEN concat(out, '...') ELSE out END AS excerpt FROM (SELECT id, any_value(body) AS body, trim(coalesce(string_agg(part, ' ' ORDER BY i) FILTER (i < least(stop, 1000000)), ''), ' ') AS out FROM
 (SELECT *, coalesce(min(CASE WHEN before + raw > 300 AND before > 100 THEN i END) OVER (PARTITION BY id), 1000000) AS stop FROM (SELECT id, body, i, part, raw, greatest(0, sum(length(part)) OVER (PARTITION BY id ORDER BY i) - length(part) + i - 2) AS before FROM
 (SELECT id, body, unnest(generate_series(1, len(s))) AS i, trim(unnest(s)) AS part, length(unnest(s)) AS raw FROM (SELECT id, body, CASE WHEN len(f) > 0 THEN f ELSE [body] END AS s FROM (SELECT id, body, regexp_extract_all(body, '[^.!?]*[.!?]+') AS f FROM (SELECT id, replace(body, chr(10), ' ') AS body FROM texts WHERE body <> '')))))) GROUP BY id)""", TEXTS)
def fn_excerpt(spark, sf):
    """Whole sentences of each text up to about 280 characters."""
    t = table(spark, sf, "documents").filter("text <> ''").select(F.col("doc_id").alias("id"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("body"))
    return t.select("id", text.excerpt(F.col("body")).alias("excerpt"))


@query("SELECT event_id, json_extract_string(props, '$.k')::bigint AS k, user_id FROM events")
def txt_salvaged_json(spark, sf):
    """The object in a reply that says more than it."""
    reply = F.concat(F.lit("Here it is: "), F.concat(F.substring_index("props", "}", 1), F.format_string(', "u": %d}', F.col("user_id"))), F.lit(" (end)"))
    rows = table(spark, sf, "events").select("event_id", text.salvaged_json(reply, "k bigint, u bigint").alias("x"))
    return rows.select("event_id", "x.k", F.col("x.u").alias("user_id"))


@query("SELECT event_id, concat('type=', event_type, '&user=', user_id::varchar) AS query FROM events")
def fn_canonical_query(spark, sf):
    params = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("type"), F.col("event_type"), F.lit("none"), F.lit(""), F.lit("null"), F.lit(None).cast("string"))
    return table(spark, sf, "events").select("event_id", text.canonical_query(params).alias("query"))


@query(f"SELECT page_id, concat('<t>', replace(replace(replace(replace(replace({RAW_TITLE}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;'), '</t>') AS escaped, regexp_replace(replace({RAW_TITLE}, '&', '&amp;'), '&amp;((?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)', '&\\1', 'g') AS repaired FROM pages")
def txt_xml(spark, sf):
    p = _pages(spark, sf)
    return p.select("page_id", F.concat(F.lit("<t>"), markup.xml_escaped(F.col("raw_title")), F.lit("</t>")).alias("escaped"), markup.repaired(F.col("raw_title")).alias("repaired"))


@query(f"SELECT page_id, concat(url, CASE {KIND} WHEN 'a' THEN '/m.jpg' WHEN 'b' THEN '/e.png' ELSE '/i.gif' END) AS image, CASE WHEN {KIND} = 'c' THEN concat(url, '/v.mp4') ELSE '' END AS videos FROM pages")
def fn_media_chain(spark, sf):
    """The picture of an item by the chain of places, and the videos of its text."""
    u = lambda end: F.concat(F.col("url"), F.lit(end))
    block = F.when(F.startswith("url", F.lit("https:")), F.format_string('<enclosure url="%s" type="image/png"/><media:content url="%s"/>', u("/e.png"), u("/m.jpg"))).when(F.contains("url", F.lit(".org")), F.format_string('<enclosure url="%s" type="audio/mp3"/><enclosure url="%s" type="image/png"/>', u("/a.mp3"), u("/e.png"))).otherwise(F.format_string('<description>&lt;img src="%s"&gt; <video src="%s"></video></description>', u("/i.gif"), u("/v.mp4")))
    return table(spark, sf, "pages").select("page_id", markup.media_url(block).alias("image"), F.array_join(markup.videos(block), ",").alias("videos"))


@query("SELECT conv_id, count(*) FILTER (trim(x) <> '') AS n FROM (SELECT conv_id, unnest(string_split(concat_ws(',', role, ' ', '', turn::varchar), ',')) AS x FROM conversations) GROUP BY 1")
def fn_csv_counts(spark, sf):
    """Entries of comma-separated lists, blanks left out."""
    listed = F.concat_ws(",", "role", F.lit(" "), F.lit(""), F.col("turn").cast("string"))
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(text.csv_count(listed)).alias("n"))


# ---- validity

GARBAGE = ["404 not found", "access denied", "lorem ipsum", "%%%", "wp-content", "maintenance"]
PRESS = [r"the .* (?:said|of the)\b", "excellent|historic", r"(?:presented|opened) .*", "press ?: ?office", "und .* die"]
USABLE_SQL = f"length(trim(regexp_replace(summary, '<[^>]+>', '', 'g'))) >= 30 AND NOT regexp_matches(concat_ws(' ', trim(regexp_replace(title, '<[^>]+>', '', 'g')), trim(regexp_replace(summary, '<[^>]+>', '', 'g'))), '(?i){'|'.join(GARBAGE)}') AND lower(trim(regexp_replace(title, '<[^>]+>', '', 'g'))) NOT IN ({', '.join(repr(t) for t in scoring.GENERIC_TITLES)})"
PRESS_SQL = "regexp_matches(concat_ws(' ', title, summary), '(?i)" + "|".join(PRESS) + "')"


@query(f"SELECT id, {USABLE_SQL} AS usable FROM (SELECT id, coalesce(title, '') AS title, coalesce(summary, '') AS summary FROM texts WHERE NOT coalesce(regexp_matches(body, '(?i)404 not found|access denied|lorem ipsum|\\||%%%'), false) AND length(trim(title)) >= 5 AND (length(trim(summary)) >= 20 OR length(trim(body)) >= 100))", TEXTS)
def txt_valid_pipeline(spark, sf):
    """Error pages go, then invalid items; of the rest it is told what a synthesis may use."""
    from tidewire.plans.content import ERRORS

    t = texts(spark, sf).filter(~scoring.matches_any(F.col("body"), ERRORS)).filter(scoring.is_valid(F.col("title"), F.lit("http://x"), F.col("summary"), F.col("body")))
    return t.select("id", scoring.usable(F.col("title"), F.col("summary"), GARBAGE).alias("usable"))


@query(f"SELECT id, {PRESS_SQL} AS is_press FROM texts WHERE title IS NOT NULL", TEXTS)
def txt_press(spark, sf):
    t = texts(spark, sf).filter("title is not null")
    return t.select("id", scoring.matches_any(F.concat_ws(" ", "title", "summary"), PRESS).alias("is_press"))


@query(f"""SELECT id, CASE WHEN ({REJECT_SQL}) IS NOT NULL THEN 0.1::double ELSE round(greatest(0, least(1, base - CASE WHEN {PRESS_SQL} THEN 0.25::double ELSE 0 END)), 2) END AS quality FROM (SELECT *, round(greatest(0, least(1, 0.7::double - CASE WHEN length(title) < 30 THEN 0.15::double WHEN length(title) > 80 THEN 0.05::double ELSE 0 END + CASE WHEN length(summary) < 50 THEN -0.25::double WHEN length(summary) > 300 THEN 0.1::double ELSE 0 END
 + CASE WHEN category IN ('en') THEN 0.05::double WHEN category IN ('de') THEN -0.1::double ELSE 0 END - CASE WHEN coalesce(press_flag = 1, false) THEN 0.35::double ELSE 0 END - CASE WHEN abs((id * 37) % 201 - 100) > 70 THEN 0.15::double ELSE 0 END)), 2) AS base FROM texts WHERE body IS NOT NULL)""", TEXTS)
def txt_quality_full(spark, sf):
    """Quality by shape with every term: bias, rejection, and the detector of press releases."""
    t = texts(spark, sf).filter("body is not null")
    bias = ((F.col("id") * 37) % 201 - 100).cast("double") / 100
    base = scoring.quality_by_shape(F.col("title"), F.col("summary"), F.col("category"), bias, F.coalesce(F.col("press_flag") == 1, F.lit(False)), ["en"], ["de"])
    press = scoring.matches_any(F.concat_ws(" ", "title", "summary"), PRESS)
    return t.select("id", scoring.rejected_shape(base, scoring.rejection(F.col("body"), FAMILIES), press).alias("quality"))


REPEATED = """EXISTS (SELECT 1 FROM dated b WHERE b.title = a.title AND (b.day < a.day OR (b.day = a.day AND b.id < a.id)) AND b.day >= a.day - 7)"""


@query(f"""WITH {TEXTS}, dated AS (SELECT id, lower(title) AS title, coalesce(body, '') AS body, (id % 30)::int AS day FROM texts WHERE title IS NOT NULL)
 SELECT id, CASE WHEN contains(title, 'thshst') THEN 'keyword:thshst' WHEN contains(title, 'pathetic') THEN 'keyword:pathetic' WHEN length(body) < 60 THEN concat('short:', length(body)::varchar) WHEN {REPEATED} THEN 'duplicate title' END AS reason FROM dated a""")
def txt_reject_titles(spark, sf):
    """Keywords, short bodies, titles that an earlier item of the last seven days had. Days run from the ids."""
    t = texts(spark, sf).filter("title is not null").select("id", F.lower("title").alias("title"), F.coalesce("body", F.lit("")).alias("body"), (F.col("id") % 30).cast("int").alias("day"))
    return scoring.rejected_titles(t, ["thshst", "pathetic"], least=60, days=7)


# ---- scores

RIGHT_SQL = f"list_filter({_sql_list(RIGHT)}, lambda t: contains(translate(lower(body), 'áàâäãåéèêëíìîïóòôöõúùûüñç', 'aaaaaaeeeeiiiiooooouuuunc'), t))"
LEFT_SQL = RIGHT_SQL.replace(_sql_list(RIGHT), _sql_list(LEFT))
NAMES_SQL = RIGHT_SQL.replace(_sql_list(RIGHT), _sql_list(NAMES))


@query(f"""SELECT id, array_to_string(r, '|') AS right_hits, array_to_string(l, '|') AS left_hits, array_to_string(e, '|') AS entities, round(least(1, p * 0.5::double + least(0.3::double, n * 0.1::double) + least(0.2::double, len(e) * 0.05::double) + CASE WHEN signals > 1 THEN 0.1::double ELSE 0 END), 2) AS confidence FROM
 (SELECT *, len(r) + len(l) AS n, 1 + CASE WHEN len(r) + len(l) > 0 THEN 1 ELSE 0 END + CASE WHEN len(e) > 0 THEN 1 ELSE 0 END AS signals FROM
 (SELECT id, {RIGHT_SQL} AS r, {LEFT_SQL} AS l, {NAMES_SQL} AS e, CASE WHEN contains(source_name, 'src1') THEN 0.8::double WHEN contains(source_name, 'src2') THEN 0.9::double ELSE 0.3::double END AS p FROM texts WHERE body IS NOT NULL))""", TEXTS)
def txt_fusion_evidence(spark, sf):
    """What a fused score rests on, and how sure it is."""
    b = F.col("body")
    parts = texts(spark, sf).filter("body is not null").select("id", lexicon.source_prior(F.col("source_name"), REGISTRY).alias("prior"), lexicon.framing(b, RIGHT, LEFT).alias("framing"), lexicon.entities_in(b, NAMES).alias("entities"))
    names = F.transform("entities", lambda e: e["name"])
    sure = lexicon.fusion_confidence(F.when(F.col("prior.confidence") > 0.2, F.col("prior.confidence")), F.col("framing.n"), F.size("entities"))
    return parts.select("id", F.array_join("framing.right", "|").alias("right_hits"), F.array_join("framing.left", "|").alias("left_hits"), F.array_join(names, "|").alias("entities"), sure.alias("confidence"))


def _kind_sql(kind: str, pattern: str, most: int) -> str:
    """What the patterns of facts find, in RE2, whose \\b knows ASCII only and which can't look behind.

    Words of letters of any alphabet are told by marks put in the text: a ~ where a name or a
    place begins, else a _ between a letter or digit of ASCII and one that is not.
    """
    word, other = r"\pL\pM\p{Nd}", "(" + "|".join(rf"[^\x00-\x7F\P{{{c}}}]" for c in ("L", "M", "Nd")) + ")"
    bare = pattern.replace(facts.BEGINS, "").replace("(?iu)", "").replace(r"\s", r"[\s\x0B]")
    if kind in ("name", "place"):
        first = facts.CAPITAL if kind == "name" else bare[: bare.index(" ") + 1] + facts.CAPITAL
        text = f"regexp_replace(replace(text, '~', '|'), '(^|[^{word}_])({first})', '\\1~\\2', 'g')"
        found = bare.replace(facts.CAPITAL, f"~{facts.CAPITAL}") if kind == "name" else f"~{bare}"
        return f"array_to_string(list_slice(list_sort(list_distinct(list_transform(regexp_extract_all({text}, '{found}'), lambda x: replace(x, '~', '')))), 1, {most}), ';')"
    # Months have letters with marks themselves.
    plain = "([0-9_])" if kind == "date" else "([A-Za-z0-9_])"
    text = f"regexp_replace(regexp_replace(text, '{plain}{other}', '\\1_\\2', 'g'), '{other}{plain}', '\\1_\\2', 'g')"
    found = ("(?i)" if "(?iu)" in pattern else "") + ("\\b" if facts.BEGINS in pattern else "") + bare.replace(facts.ENDS, "\\b")
    return f"array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all({text}, '{found}'))), 1, {most}), ';')"


@query(f"SELECT doc_id, {', '.join(f'{_kind_sql(k, *v)} AS {k}s' for k, v in facts.ENTITIES.items())} FROM (SELECT doc_id, concat(text, ' On 3/4/2021, $ 12.500 MILLONES or $5 mil in Paris, 7% of 12.345,6 on 4 de Mayo de 2020.') AS text FROM documents WHERE text IS NOT NULL)")
def facts_entity_kinds(spark, sf):
    """Dates, sums of money, percentages, numbers, names and places; each text is given some of the first, which the tables lack."""
    told = F.concat("text", F.lit(" On 3/4/2021, $ 12.500 MILLONES or $5 mil in Paris, 7% of 12.345,6 on 4 de Mayo de 2020."))
    found = facts.entities_by_kind(told)
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", *[F.array_join(c, ";").alias(f"{k}s") for k, c in found.items()])


@query("SELECT id, CASE WHEN length(t) < 5 THEN 'Synthesis' ELSE t END AS title FROM (SELECT id, trim(regexp_replace(regexp_replace(CASE WHEN category = 'en' THEN concat('BREAKING: ', title) WHEN category = 'de' THEN concat('Urgent - <b>', title, '</b>') ELSE title END, '(?i)^\\s*(?:breaking|urgent|exclusive|alert)\\s*[-:]\\s*', ''), '<[^>]+>', '', 'g')) AS t FROM texts WHERE title IS NOT NULL)", TEXTS)
def fn_calm_title(spark, sf):
    """Titles without shouts; English and German ones are given some."""
    loud = F.when(F.col("category") == "en", F.concat(F.lit("BREAKING: "), "title")).when(F.col("category") == "de", F.concat(F.lit("Urgent - <b>"), F.col("title"), F.lit("</b>"))).otherwise(F.col("title"))
    return texts(spark, sf).filter("title is not null").select("id", facts.calm_title(loud).alias("title"))


@query(f"SELECT id, n AS n_topics FROM (SELECT id, {_phrase_hits(PRO)} AS n FROM texts WHERE body IS NOT NULL)", TEXTS)
def txt_phrase_counts(spark, sf):
    return texts(spark, sf).filter("body is not null").select("id", F.size(lexicon.once(text.fold(F.col("body")), lambda t: lexicon.phrase_hits(t, PRO))).cast("bigint").alias("n_topics"))
