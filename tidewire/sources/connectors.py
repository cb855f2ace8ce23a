"""Connectors by name: which URLs each takes, how it reads what was fetched, and which result of several is used."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions import urls
from tidewire.sources import markup


@dataclass(frozen=True)
class Connector:
    """``accepts`` tells of a URL whether the connector may be tried; ``items`` makes (id, title, url) of bodies (id, url, body)."""

    name: str
    priority: int
    accepts: Callable[[Column], Column]
    items: Callable[[DataFrame], DataFrame]
    #: Of a page's address and its HTML, which may be null: whether trying the connector makes sense. Any address that it accepts by default.
    capable: Callable[[Column, Column], Column] | None = None


# Parts of addresses and pages by which connectors are chosen.
FEED_MARKS = ("/feed", "/rss", ".xml", "feedburner")
FEED_LINKS = ('type="application/rss+xml"', 'type="application/atom+xml"')
WORDPRESS_MARKS = ("wp-json", "WordPress")
NO_ARTICLE = ("/feed", "/rss", ".xml", "/tag/", "/category/")


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(text, F.lit(m)), F.lit(False)) for m in marks])


def _feed_like(url: Column, html: Column) -> Column:
    return _holds(F.lower(url), FEED_MARKS) | _holds(html, FEED_LINKS)


def _wordpress_like(url: Column, html: Column) -> Column:
    return F.when(F.coalesce(html, F.lit("")) != "", _holds(html, WORDPRESS_MARKS)).otherwise(F.contains(url, F.lit("/wp-")))


def _article_like(url: Column, html: Column) -> Column:
    return ~_holds(F.lower(url), NO_ARTICLE)


def _rss(bodies: DataFrame) -> DataFrame:
    return markup.rss_items(bodies.withColumnRenamed("id", "feed_id")).select(F.col("feed_id").alias("id"), "title", "url")


def _posts(bodies: DataFrame) -> DataFrame:
    return markup.posts(bodies.withColumnRenamed("id", "site_id")).select(F.col("site_id").alias("id"), "title", "url")


def _sitemap(bodies: DataFrame) -> DataFrame:
    return markup.sitemap_urls(bodies.withColumnRenamed("id", "map_id")).select(F.col("map_id").alias("id"), "title", "url")


def _article(bodies: DataFrame) -> DataFrame:
    found = markup.article(bodies.select(F.col("id").alias("page_id"), F.col("body").alias("html")))
    return found.join(bodies.select(F.col("id").alias("page_id"), "url"), "page_id").select(F.col("page_id").alias("id"), "title", "url")


def _reader(bodies: DataFrame) -> DataFrame:
    return markup.reader_reply(bodies).select("id", "title", "url")


#: Connectors by name. A project adds its own with ``register``.
CONNECTORS: dict[str, Connector] = {}


def register(connector: Connector) -> None:
    CONNECTORS[connector.name] = connector


for _c in (
    Connector("rss", 1, urls.is_web, _rss, _feed_like),
    Connector("wordpress", 2, urls.is_web, _posts, _wordpress_like),
    Connector("sitemap", 3, urls.is_web, _sitemap),
    Connector("article", 5, urls.is_web, _article, _article_like),
    Connector("reader", 6, urls.is_web, _reader),
):
    register(_c)


def harvest(fetched: DataFrame) -> DataFrame:
    """(id, connector, title, url): what each connector reads of the bodies (id, connector, url, body) that were fetched for it."""
    rows = [c.items(fetched.filter((F.col("connector") == c.name) & c.accepts(F.col("url"))).select("id", "url", "body")).withColumn("connector", F.lit(c.name)) for c in CONNECTORS.values()]
    return reduce(DataFrame.unionByName, rows).select("id", "connector", "title", "url")


def capable(url: Column, html: Column) -> Column:
    """Names of the connectors that may be tried for a page, best first."""
    ranked = sorted(CONNECTORS.values(), key=lambda c: (c.priority, c.name))
    each = [F.when(c.accepts(url) & (c.capable(url, html) if c.capable else F.lit(True)), F.lit(c.name)) for c in ranked]
    return F.array_compact(F.array(*each))


def first_parsed(candidates: DataFrame, fetched: DataFrame) -> DataFrame:
    """(page_id, feed_url, position, item, title, url): per page the items of the first candidate (page_id, position, feed_url) that is a feed with items.

    ``fetched`` (feed_url, body, content_type) is what was fetched, once per address. Each is
    tested and parsed once, however many pages name it.
    """
    feeds = fetched.filter(markup.feed_reply(F.col("body"), F.col("content_type"))).select(F.col("feed_url").alias("feed_id"), "body")
    rss, atom = markup.rss_items(feeds), markup.atom_items(feeds)
    items = rss.unionByName(atom).select(F.col("feed_id").alias("feed_url"), F.col("position").alias("item"), "title", "url")
    used = candidates.join(items.select("feed_url").distinct(), "feed_url", "left_semi")
    first = used.groupBy("page_id").agg(F.min(F.struct("position", "feed_url")).alias("x")).select("page_id", "x.position", "x.feed_url")
    return first.join(items, "feed_url").select("page_id", "feed_url", "position", "item", "title", "url")


def priority_of(name: Column) -> Column:
    known = [x for c in CONNECTORS.values() for x in (F.lit(c.name), F.lit(c.priority))]
    return F.coalesce(F.try_element_at(F.create_map(*known), name), F.lit(1000))


def first_result(results: DataFrame, key: str, learned: DataFrame, open_breakers: DataFrame) -> DataFrame:
    """Per key the connector whose result is used, of results (key, connector, n_items).

    The learned connector (key, learned) is first, then they go by priority; empty results, and
    connectors whose breaker is open for the key (key, connector), are passed over.
    """
    tried = results.filter("n_items > 0").join(open_breakers.select(key, "connector"), [key, "connector"], "left_anti")
    ranked = tried.join(learned.select(key, "learned"), key, "left")
    order = F.struct(F.when(F.col("connector") == F.col("learned"), 0).otherwise(1), priority_of(F.col("connector")), F.col("connector"))
    return ranked.groupBy(key).agg(F.min_by(F.struct("connector", "n_items"), order).alias("x")).select(key, "x.connector", "x.n_items")
