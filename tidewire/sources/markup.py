"""Columns and rows from markup that has been fetched already: HTML pages, feeds, sitemaps, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.functions.text import strip_tags, unescape
from tidewire.functions.times import parse_date
from tidewire.functions.urls import slug_title


def first_tag(markup: Column, tag: str) -> Column:
    """The content of the first element of that name, null without one."""
    return F.nullif(F.trim(unwrapped(F.regexp_extract(markup, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1))), F.lit(""))


def unwrapped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")


def link_text(markup: Column, tag: str) -> Column:
    """The link that stands in the first element of that name: references are resolved, but not in a CDATA section."""
    raw = F.regexp_extract(markup, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)
    marked = F.rlike(raw, F.lit(r"(?s)^\s*<!\[CDATA\["))
    return F.nullif(F.trim(F.when(marked, unwrapped(raw)).otherwise(unescape(raw))), F.lit(""))


def attribute(markup: Column, tag: str, name: str, where: str = "") -> Column:
    """An attribute of the first element ``tag`` that has it (and matches ``where``), null without one."""
    return F.nullif(F.regexp_extract(markup, f"(?is)<{tag}(?=[^>]*{where})[^>]*\\s{name}=[\"']([^\"']*)[\"']", 1), F.lit(""))


def links(html: Column) -> Column:
    """Targets of anchors in order."""
    return F.regexp_extract_all(html, F.lit("(?i)<a\\s[^>]*href=[\"']([^\"']+)[\"']"), F.lit(1))


def page_title(html: Column) -> Column:
    return unescape(F.coalesce(first_tag(html, "title"), first_tag(html, "h1")))


def page_text(html: Column) -> Column:
    """Visible text: no scripts, styles or tags, single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(unescape(strip_tags(bare, " ")), r"\s+", " "))


def best_text(candidates: list[Column], enough: int = 200) -> Column:
    """The first candidate longer than ``enough``, else the first one given."""
    return F.coalesce(*[F.when(F.length(c) > enough, c) for c in candidates], *candidates)


#: Elements that hold a page's own text, best first.
CONTAINERS = ("article", "main", "body")


def rendered_text(html: Column, containers: tuple[str, ...] = CONTAINERS, enough: int = 200) -> Column:
    """The visible text of the first container with more than ``enough`` characters, else of the first with any, else null."""
    inside = lambda tag: F.nullif(page_text(F.regexp_extract(html, f"(?is)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>", 1)), F.lit(""))
    return best_text([inside(tag) for tag in containers], enough)


def article(pages: DataFrame, least: int = 50, most: int = 3000) -> DataFrame:
    """(page_id, title, text, n_chars) of pages with a title and ``least`` characters of text."""
    parsed = pages.select("page_id", page_title(F.col("html")).alias("title"), page_text(F.col("html")).alias("whole"))
    good = parsed.filter((F.coalesce("title", F.lit("")) != "") & (F.length("whole") >= least))
    return good.select("page_id", "title", F.left("whole", F.lit(most)).alias("text"), F.length("whole").cast("bigint").alias("n_chars"))


def sniff(html: Column) -> dict[str, Column]:
    """Structure of a page: which system made it, what it holds."""
    has = lambda p: F.rlike(html, F.lit(p))
    return {
        "is_wordpress": has("(?i)wp-content|wp-json"),
        "is_drupal": has("(?i)drupal"),
        "has_article": has("(?i)<article"),
        "has_main": has("(?i)<main"),
        "has_nav": has("(?i)<nav"),
        "has_meta_description": has("(?i)<meta[^>]*name=[\"']description"),
        "has_script": has("(?i)<script"),
    }


# Where sites keep their feeds when no link names one, in the order in which they are tried.
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/feed.xml", "/atom.xml", "/feeds/posts/default")
#: Types of links that name feeds.
FEED_TYPES = r"(?:application/(?:rss\+|atom\+)?xml|text/xml)"


def discovered_feeds(pages: DataFrame) -> DataFrame:
    """(page_id, position, feed_url, feed_type) from the feed links of pages (page_id, url, html), resolved against the page; the usual places, of no known type, where there are none."""
    tags = F.regexp_extract_all("html", F.lit(f"(?i)<link[^>]*type=[\"']{FEED_TYPES}[\"'][^>]*>"), F.lit(0))
    parts = F.transform(tags, lambda t: F.struct(unescape(F.regexp_extract(t, "(?i)href=[\"']([^\"']+)[\"']", 1)).alias("href"), F.when(F.rlike(t, F.lit("(?i)type=[\"']application/atom")), "atom").otherwise("rss").alias("feed_type")))
    named = F.filter(parts, lambda p: F.trim(p["href"]) != "")
    found = F.transform(named, lambda p: F.struct(urls.resolved(p["href"], F.col("url")).alias("feed_url"), p["feed_type"].alias("feed_type")))
    # Of links to one place the first counts.
    first = F.filter(found, lambda p, i: F.array_position(F.transform(found, lambda q: q["feed_url"]), p["feed_url"]) == i + 1)
    usual = F.transform(F.array(*map(F.lit, FEED_PATHS)), lambda p: F.struct(F.concat(urls.root(F.col("url")), p).alias("feed_url"), F.lit(None).cast("string").alias("feed_type")))
    return pages.select("page_id", F.posexplode(F.when(F.size(first) > 0, first).otherwise(usual)).alias("position", "x")).select("page_id", "position", "x.*")


def selectors(html: Column, patterns: list[str], most: int = 5, longest: int = 100) -> Column:
    """The first different tags that the patterns find, cut to ``longest``."""
    found = F.flatten(F.array(*[F.regexp_extract_all(html, F.lit("(?i)" + p), F.lit(0)) for p in patterns]))
    return F.slice(F.array_distinct(F.transform(found, lambda t: F.left(t, F.lit(longest)))), 1, most)


def meta(html: Column, name: str) -> Column:
    """The content of a meta tag, null without one."""
    return attribute(html, "meta", "content", f"(?:name|property)=[\"']{name}[\"']")


def feed_reply(body: Column, content_type: Column) -> Column:
    """Whether a reply is a feed: an XML type, or a feed's root tag."""
    return F.coalesce(F.rlike(content_type, F.lit("(?i)xml|rss|atom")), F.lit(False)) | is_feed(body)


def is_feed(body: Column) -> Column:
    return F.coalesce(F.rlike(body, F.lit("(?i)<rss|<feed|<rdf")), F.lit(False))


def _item_rows(feeds: DataFrame, tag: str, most: int) -> DataFrame:
    blocks = F.regexp_extract_all("body", F.lit(f"(?is)<{tag}[\\s>].*?</{tag}>"), F.lit(0))
    return feeds.select("feed_id", F.posexplode(F.slice(blocks, 1, most)).alias("position", "block"))


def rss_items(feeds: DataFrame, most: int = 20) -> DataFrame:
    """Items of RSS bodies (feed_id, body): the first ``most``, without those that lack a title or a link."""
    x = F.col("block")
    image = media_url(x)
    summary = F.left(F.trim(strip_tags(unescape(F.coalesce(first_tag(x, "description"), first_tag(x, "content:encoded"), F.lit(""))))), F.lit(500))
    rows = _item_rows(feeds, "item", most).select("feed_id", "position", unescape(first_tag(x, "title")).alias("title"), F.coalesce(link_text(x, "link"), link_text(x, "guid")).alias("url"), summary.alias("summary"), image.alias("image_url"), parse_date(first_tag(x, "pubDate")).alias("published_at"))
    return rows.filter("title is not null and url is not null")


def atom_items(feeds: DataFrame, most: int = 20) -> DataFrame:
    """Entries of Atom bodies, like rss_items. The link is the alternate one, else one without a rel, else the first."""
    x = F.col("block")
    url = unescape(F.coalesce(attribute(x, "link", "href", "\\srel=[\"']alternate[\"']"), F.nullif(F.regexp_extract(x, "(?is)<link(?![^>]*\\srel=)[^>]*\\shref=[\"']([^\"']*)[\"']", 1), F.lit("")), attribute(x, "link", "href")))
    rows = _item_rows(feeds, "entry", most).select("feed_id", "position", unescape(first_tag(x, "title")).alias("title"), url.alias("url"), F.left(F.trim(strip_tags(unescape(F.coalesce(first_tag(x, "summary"), first_tag(x, "content"), F.lit(""))))), F.lit(500)).alias("summary"), F.lit(None).cast("string").alias("image_url"), parse_date(F.coalesce(first_tag(x, "published"), first_tag(x, "updated"))).alias("published_at"))
    return rows.filter("title is not null and url is not null")


def sitemap_urls(maps: DataFrame, most: int = 20) -> DataFrame:
    """(map_id, position, url, title) of sitemap bodies (map_id, body); titles come from the URLs."""
    found = F.regexp_extract_all("body", F.lit(r"(?is)<url>.*?<loc>\s*(.*?)\s*</loc>"), F.lit(1))
    rows = maps.select("map_id", F.posexplode(F.slice(found, 1, most)).alias("position", "raw"))
    return rows.select("map_id", "position", unescape(F.col("raw")).alias("url")).withColumn("title", slug_title(F.col("url")))


def xml_escaped(text: Column) -> Column:
    """Text as it stands between tags and in attributes."""
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def repaired(xml: Column) -> Column:
    """Ampersands that begin no character reference are escaped."""
    return F.regexp_replace(xml, r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def media_url(block: Column) -> Column:
    """A feed item's picture: media content, thumbnail, an image enclosure, any enclosure, a picture in the text."""
    return F.coalesce(attribute(block, "media:content", "url"), attribute(block, "media:thumbnail", "url"), attribute(block, "enclosure", "url", "type=[\"']image"), attribute(block, "enclosure", "url"), attribute(unescape(block), "img", "src"))


def videos(block: Column) -> Column:
    """Sources of the video elements of a feed item's text, in order."""
    return F.regexp_extract_all(block, F.lit("(?i)<video[^>]*src=[\"']([^\"']+)[\"']"), F.lit(1))


def reader_reply(replies: DataFrame) -> DataFrame:
    """(id, url, title, summary, text) of a reader service's JSON replies (id, url, body); those without content go."""
    data = F.from_json("body", "struct<data:struct<title:string,content:string>>")["data"]
    rows = replies.select("id", "url", data.alias("data")).filter("coalesce(data.content, '') != ''")
    title = F.coalesce(F.nullif(F.col("data.title"), F.lit("")), slug_title(F.col("url")))
    return rows.select("id", "url", title.alias("title"), F.left("data.content", F.lit(500)).alias("summary"), F.left("data.content", F.lit(3000)).alias("text"))


POST = "array<struct<link:string,date_gmt:string,title:struct<rendered:string>,excerpt:struct<rendered:string>,_embedded:struct<`wp:featuredmedia`:array<struct<source_url:string>>>>>"


def posts(bodies: DataFrame) -> DataFrame:
    """Posts of a site's JSON interface (site_id, body)."""
    rows = bodies.select("site_id", F.posexplode(F.from_json("body", POST)).alias("position", "post"))
    p = F.col("post")
    return rows.select("site_id", "position", unescape(strip_tags(p["title"]["rendered"])).alias("title"), p["link"].alias("url"), F.trim(unescape(strip_tags(p["excerpt"]["rendered"]))).alias("summary"), F.get(p["_embedded"]["wp:featuredmedia"], F.lit(0))["source_url"].alias("image_url"), parse_date(p["date_gmt"]).alias("published_at"))
