"""Rows that the tables do not hold, one by one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import facts
from tidewire.sources import connectors, markup


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("told", "kind", "want"),
    [
        ("cost $ 5 millones now", "money", ["$ 5 millones"]),
        ("cost $3 BILLONES or $2.500,50 mil or $7", "money", ["$2.500,50 mil", "$3 BILLONES", "$7"]),
        ("for $4M and $9 K and $8 milagros", "money", ["$4M", "$8", "$9 K"]),
        ("grew 7% and 12％ of 30", "percent", ["12％", "7%"]),
        ("on 4 de Mayo de 2020, 1/2/21 and 03-04-1999", "date", ["03-04-1999", "1/2/21", "4 de Mayo de 2020"]),
        ("12.345,6 and 1,000 and 7.5 and 42", "number", ["1,000", "12.345,6", "42", "7.5"]),
        ("said Ana Paz, Luis and Juan Carlos Sosa Gil Mota", "name", ["Ana Paz", "Juan Carlos Sosa Gil"]),
        ("born in Paris, then of Rosario", "place", ["in Paris", "of Rosario"]),
    ],
)
def test_entities(spark, told, kind, want):
    assert one(spark, told, lambda c: facts.entities_by_kind(c)[kind]) == want


def test_units_are_a_parameter(spark):
    assert one(spark, "$5 thousand and $6 mil", lambda c: facts.entities_by_kind(c, facts.entity_kinds(units=("thousand",)))["money"]) == ["$5 thousand", "$6"]


def test_feeds_of_many_items(spark):
    items = [f"<item><title>T{i}</title><link>http://x/?a={i}&amp;b=2</link></item>" for i in range(25)]
    items[3] = "<item><title>no link</title></item>"
    items[4] = "<item><title>T4</title><link><![CDATA[ http://x/?a=4&amp;b=2 ]]></link><guid>http://x/g</guid></item>"
    items[5] = "<item><title>T5</title><link/><guid isPermaLink='true'>http://x/5?p=1&#38;q=2</guid></item>".replace("&#38;", "&amp;")
    rows = markup.rss_items(spark.createDataFrame([(1, "<rss>" + "".join(items) + "</rss>")], "feed_id long, body string")).orderBy("position").collect()
    assert [r["position"] for r in rows] == [i for i in range(20) if i != 3]
    assert rows[0]["url"] == "http://x/?a=0&b=2" and rows[3]["url"] == "http://x/?a=4&amp;b=2" and rows[4]["url"] == "http://x/5?p=1&q=2"


@pytest.mark.parametrize(
    ("links", "want"),
    [
        ('<link rel="self" href="http://x/self"/><link rel="alternate" href="http://x/a?b=1&amp;c=2"/>', "http://x/a?b=1&c=2"),
        ('<link rel="self" href="http://x/self"/><link href="http://x/plain"/>', "http://x/plain"),
        ('<link type="text/html" href="http://x/late" rel="alternate"/><link rel="edit" href="http://x/e"/>', "http://x/late"),
        ('<link rel="enclosure" href="http://x/only"/>', "http://x/only"),
    ],
)
def test_the_link_of_an_entry(spark, links, want):
    body = f"<feed><entry><title>t</title>{links}</entry></feed>"
    assert markup.atom_items(spark.createDataFrame([(1, body)], "feed_id long, body string")).first()["url"] == want


def test_feeds_of_a_page(spark):
    html = '<link type="application/rss+xml" href="news.xml"><link href="//cdn.x/f.xml" type="application/atom+xml"><link type="text/xml" href="../up?a=1&amp;b=2"><link type="text/xml" href="https://h.com/dir/news.xml">'
    rows = markup.discovered_feeds(spark.createDataFrame([(1, "https://h.com/dir/page.html", html), (2, "http://o.org/x", "<p>")], "page_id long, url string, html string")).orderBy("page_id", "position").collect()
    assert [(r["feed_url"], r["feed_type"]) for r in rows if r["page_id"] == 1] == [("https://h.com/dir/news.xml", "rss"), ("https://cdn.x/f.xml", "atom"), ("https://h.com/up?a=1&b=2", "rss")]
    assert [(r["feed_url"], r["feed_type"]) for r in rows if r["page_id"] == 2] == [(f"http://o.org{p}", None) for p in markup.FEED_PATHS]


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>A&amp;b</p> [Facebook](http://f) [] [TikTok clip](http://t/x) end", "A&b end"),
        ("Text.  LEER MÁS  more", "Text.more"),
        ("Kept [a link](http://x) The post <b>was</b> here", "Kept [a link](http://x)"),
    ],
)
def test_cleaned_snippets(spark, html, want):
    assert one(spark, html, text.clean_html) == want


def test_snippets_in_another_language(spark):
    assert one(spark, "A [Mastodon](http://m) Read on", lambda c: text.clean_html(c, social=("Mastodon",), read_more=("Read on",))) == "A"


@pytest.mark.parametrize(
    ("url", "html", "want"),
    [
        ("http://x/feed/", None, ["rss", "sitemap", "reader"]),
        ("http://x/wp-login", None, ["wordpress", "sitemap", "article", "reader"]),
        ("http://x/wp-login", "<p>plain</p>", ["sitemap", "article", "reader"]),
        ("http://x/a", '<link type="application/atom+xml" href="/f"> WordPress', ["rss", "wordpress", "sitemap", "article", "reader"]),
        ("http://x/TAG/a", "", ["sitemap", "reader"]),
        ("ftp://x/a", "WordPress", []),
    ],
)
def test_connectors_that_may_be_tried(spark, url, html, want):
    assert spark.createDataFrame([(url, html)], "u string, h string").select(connectors.capable(F.col("u"), F.col("h"))).first()[0] == want


def test_the_first_feed_with_items(spark):
    item = "<item><title>t</title><link>http://x/1</link></item>"
    entry = '<feed><entry><title>e</title><link href="http://x/2"/></entry></feed>'
    fetched = spark.createDataFrame([("a", "<html>", "text/html"), ("b", "<rss></rss>", None), ("c", entry, ""), ("d", f"<rss>{item}</rss>", "x")], "feed_url string, body string, content_type string")
    named = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "d"), (2, 1, "c"), (3, 0, "a"), (3, 1, "nowhere")], "page_id long, position long, feed_url string")
    assert sorted((r["page_id"], r["feed_url"], r["title"], r["url"]) for r in connectors.first_parsed(named, fetched).collect()) == [(1, "c", "e", "http://x/2"), (2, "d", "t", "http://x/1")]


def test_text_of_a_rendered_page(spark):
    long = "word " * 60
    best = lambda html: one(spark, html, markup.rendered_text)
    assert best(f"<body><article>short</article><main class='m'>{long}<script>x()</script></main></body>") == long.strip()
    assert best("<body>all <article>short</article></body>") == "short" and best("<p>nothing</p>") is None


def test_what_is_told_without_facts(spark):
    articles = spark.createDataFrame([("c", 1, 0.1, "<b>one</b>"), ("c", 2, -0.1, "two"), ("c", 3, 0.0, ""), ("c", 4, 0.15, "four"), ("d", 5, 0.9, "far"), ("d", 6, 0.5, "base"), ("e", 7, 0.0, "not told")], "cluster_id string, id long, bias double, summary string")
    found = spark.createDataFrame([("e", 1, "verified", "A fact"), ("d", 1, "disputed", "no fact")], "cluster_id string, rank long, status string, sentence string")
    got = {r["cluster_id"]: (r["base_id"], r["summary"]) for r in facts.fallback(articles, found).collect()}
    assert got == {"c": (2, "two | one"), "d": (5, "far"), "e": (7, "A fact")}
