from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewire.functions import labels, text, times, urls
from tidewire.sources import markup

RSS = """<?xml version="1.0"?><rss><channel><title>Wire</title>
<item><title><![CDATA[First & best]]></title><link>http://a/1</link><description>&lt;p&gt;Some &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</description><pubDate>Mon, 06 May 2024 10:20:30 GMT</pubDate><media:content url="http://a/1.jpg" /></item>
<item><title>No link</title></item>
<item><title>Second</title><guid>http://a/2</guid><pubDate>2024-05-07T08:00:00</pubDate><enclosure type="image/png" url="http://a/2.png"/></item>
<item><link>http://a/3</link></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>One</title><link rel="alternate" href="http://b/1"/><updated>2024-05-06T10:00:00Z</updated><summary>short</summary></entry><entry><title>Two</title></entry></feed>"""
MAP = "<urlset><url><loc> http://c/a-first-page.html </loc></url><url><lastmod>x</lastmod><loc>http://c/b</loc></url></urlset>"
POSTS = '[{"link":"http://d/1","date_gmt":"2024-05-06T10:00:00","title":{"rendered":"A &amp; B"},"excerpt":{"rendered":"<p>x</p>"},"_embedded":{"wp:featuredmedia":[{"source_url":"http://d/1.jpg"}]}},{"link":"http://d/2","title":{"rendered":"C"}}]'


def frame(spark, name, body):
    return spark.createDataFrame([(1, body), (2, ""), (3, None)], f"{name} long, body string")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rss(spark):
    rows = markup.rss_items(frame(spark, "feed_id", RSS)).orderBy("position").collect()
    assert [(r["title"], r["url"], r["summary"], r["image_url"]) for r in rows] == [("First & best", "http://a/1", "Some text", "http://a/1.jpg"), ("Second", "http://a/2", "", "http://a/2.png")]
    assert [r["published_at"] for r in rows] == [dt.datetime(2024, 5, 6, 10, 20, 30), dt.datetime(2024, 5, 7, 8)]


def test_atom(spark):
    rows = markup.atom_items(frame(spark, "feed_id", ATOM)).collect()
    assert [(r["title"], r["url"], r["summary"]) for r in rows] == [("One", "http://b/1", "short")]


def test_sitemap(spark):
    rows = markup.sitemap_urls(frame(spark, "map_id", MAP)).orderBy("position")
    assert [r["url"] for r in rows.collect()] == ["http://c/a-first-page.html", "http://c/b"]
    assert rows.select(urls.slug_title(F.col("url"))).first()[0] == "A First Page"


def test_posts(spark):
    rows = markup.posts(frame(spark, "site_id", POSTS)).orderBy("position").collect()
    assert [(r["title"], r["url"], r["summary"], r["image_url"]) for r in rows] == [("A & B", "http://d/1", "x", "http://d/1.jpg"), ("C", "http://d/2", None, None)]


def test_feed_discovery(spark):
    html = '<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link type="application/atom+xml" href="http://x/a"><link type="application/rss+xml" href="/feed.xml">'
    pages = spark.createDataFrame([(1, "http://s/p", html), (2, "http://s/q", "<p>")], "page_id long, url string, html string")
    found = [(r["page_id"], r["feed_url"]) for r in markup.discovered_feeds(pages).orderBy("page_id", "position").collect()]
    assert found[:2] == [(1, "http://s/feed.xml"), (1, "http://x/a")] and found[2] == (2, "http://s/feed") and len(found) == 2 + len(markup.FEED_PATHS)
    assert value(spark, markup.is_feed(F.lit("<RSS>"))) and not value(spark, markup.is_feed(F.lit("<html>")))


def test_page_text(spark):
    html = "<html><title>T &amp; U</title><script>x<y</script><body><h1>H</h1>a&nbsp;b</body></html>"
    assert value(spark, markup.page_title(F.lit(html))) == "T & U"
    assert value(spark, markup.page_text(F.lit(html))) == "T & U H a b"
    assert value(spark, markup.best_text([F.lit("short"), F.lit("y" * 300)])) == "y" * 300


def test_dates(spark):
    cases = {"2024-05-06": (2024, 5, 6), "2024-05-06 07:08:09": (2024, 5, 6, 7, 8, 9), "Mon, 06 May 2024 07:08:09 +0200": (2024, 5, 6, 5, 8, 9), "6 May 2024 07:08 GMT": (2024, 5, 6, 7, 8), "nonsense": None, "": None}
    for given, want in cases.items():
        assert value(spark, times.parse_date(F.lit(given))) == (want and dt.datetime(*want)), given
    label = lambda t: value(spark, times.relative_label(F.lit(t).cast("timestamp"), "2024-01-02 00:00:00"))
    assert [label(t) for t in ("2024-01-01 23:59:30", "2024-01-01 23:10:00", "2024-01-01 00:30:00", "2023-12-30 00:00:00", None)] == ["now", "50min", "23h", "3d", ""]


def test_labels(spark):
    scores = (None, 0.51, 0.5, 0.1, -0.1, -0.5, -0.51)
    assert [value(spark, labels.bias_label(F.lit(s).cast("double"))) for s in scores] == ["no data", "strong official", "mild official", "neutral", "neutral", "mild opposition", "strong opposition"]
    colour = lambda s: value(spark, labels.bias_colour(F.lit(s).cast("double")))
    assert [colour(s) for s in (-1, 0, 0.5, 1, None, 7)] == ["rgb(150,140,131)", "rgb(150,140,131)", "rgb(117,170,219)", "rgb(26,58,107)", "#94a3b8", "rgb(26,58,107)"]
    level = lambda n, q, p: value(spark, labels.signal_level(F.lit(n), F.lit(q).cast("double"), F.lit(p)))
    assert [level(1, None, False), level(5, 0.9, False), level(25, 0.7, False), level(1, 0.1, True), level(3, 0.5, True)] == [1, 7, 10, 1, 2]


def test_text(spark):
    v = lambda c: value(spark, c)
    assert v(text.normalise(F.lit("  ¡Ñandú, Área-51!  x "))) == "nandu area51 x"
    assert v(text.csv_ids(F.lit("1, 22,,x3, 7 "))) == [1, 22, 7]
    assert v(text.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert v(text.url_uuid(F.lit("http://x/ñ"))) == str(__import__("uuid").uuid5(__import__("uuid").NAMESPACE_URL, "http://x/ñ"))
    assert v(text.clean_html(F.lit("<p>A&nbsp;b</p> The post x"))) == "A b"
    assert v(text.canonical_query(F.create_map(F.lit("b"), F.lit("2 3"), F.lit("a"), F.lit("1"), F.lit("c"), F.lit("")))) == "a=1&b=2+3"
    assert v(text.salvaged_json(F.lit('```json {"a": 1} ```'), "a int"))["a"] == 1
    assert v(text.salvaged_json(F.lit("no object"), "a int")) is None
    assert v(text.initials(F.lit("ana maria paz"))) == "AM" and v(text.percent(F.lit(1), F.lit(0))) == 0.0
    long = "One sentence here. " * 30
    assert v(text.excerpt(F.lit(long))).endswith("...") and len(v(text.excerpt(F.lit(long)))) < 310
    assert [v(urls.kind(F.lit(u))) for u in ("https://www.youtube.com/x", "http://x.com/a", "http://a/feed/", "http://a/sitemap.xml", "http://box.com/a")] == ["video", "social", "feed", "sitemap", "page"]
