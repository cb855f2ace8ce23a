"""URLs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts whose pages have an embedding service.
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com")
SOCIAL_HOSTS = ("twitter.com", "x.com", "instagram.com", "facebook.com", "tiktok.com")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def domain(url: Column) -> Column:
    """The host without www., or the text itself where there is none."""
    return F.when(host(url) == "", url).otherwise(F.regexp_replace(host(url), r"^www\.", ""))


def root(url: Column) -> Column:
    """Scheme and host."""
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", 0)


def resolved(href: Column, base: Column) -> Column:
    """A reference as it is meant on the page ``base``: full, by host, by path, by directory, by query or by fragment; dots in the path are followed."""
    href = F.trim(href)
    begins = lambda c: F.startswith(href, F.lit(c))
    bare = F.regexp_replace(base, "[?#].*$", "")
    folder = F.when(F.rlike(bare, F.lit("://[^/]+/")), F.regexp_replace(bare, "[^/]*$", "")).otherwise(F.concat(bare, F.lit("/")))
    joined = (
        F.when(F.rlike(href, F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(begins("//"), F.concat(F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0), href))
        .when(begins("/"), F.concat(root(base), href))
        .when(begins("?"), F.concat(bare, href))
        .when(begins("#") | (href == ""), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    path = F.regexp_extract(joined, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    steps = F.split(F.substring(path, 2, 1_000_000), "/", -1)
    none = F.array().cast("array<string>")
    # A dot at the end leaves a folder, whose name ends with a stroke.
    ended = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
    kept = F.aggregate(ended, none, lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))))
    plain = F.concat(root(joined), F.lit("/"), F.array_join(kept, "/"), F.regexp_extract(joined, "[?#].*$", 0))
    return F.when(F.rlike(path, F.lit(r"/\.\.?(/|$)")), plain).otherwise(joined)


def is_web(url: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(url), F.lit("^https?://.")), F.lit(False))


def slug_title(url: Column) -> Column:
    """A title from the last part of the path."""
    last = F.regexp_extract(F.regexp_replace(url, "[?#].*$", ""), "([^/]*)/?$", 1)
    return F.initcap(F.replace(F.replace(last, F.lit(".html"), F.lit("")), F.lit("-"), F.lit(" ")))


def kind(url: Column) -> Column:
    """Which connector a URL belongs to: video, social, feed, sitemap or page."""
    low = F.lower(url)
    any_of = lambda names: F.rlike(domain(url), F.lit("(^|\\.)(" + "|".join(n.replace(".", "\\.") for n in names) + ")$"))
    return (
        F.when(any_of(VIDEO_HOSTS), "video")
        .when(any_of(SOCIAL_HOSTS), "social")
        .when(F.rlike(low, F.lit("/(feed|rss)(/|$|\\.xml)")), "feed")
        .when(F.contains(low, F.lit("sitemap")), "sitemap")
        .otherwise("page")
    )


def methods(url: Column) -> Column:
    """The connectors that may be tried for a URL, best first."""
    k = kind(url)
    special = F.when(k.isin("video", "social"), F.array(k)).otherwise(F.array().cast("array<string>"))
    return F.concat(special, F.array(*map(F.lit, ("rss", "wordpress", "sitemap", "article", "reader"))))


# The embedding services of hosts.
OEMBED = {
    "youtube.com": "https://www.youtube.com/oembed?url=%s&format=json",
    "youtu.be": "https://www.youtube.com/oembed?url=%s&format=json",
    "vimeo.com": "https://vimeo.com/api/oembed.json?url=%s",
    "twitter.com": "https://publish.twitter.com/oembed?url=%s",
    "x.com": "https://publish.twitter.com/oembed?url=%s",
    "tiktok.com": "https://www.tiktok.com/oembed?url=%s",
    "instagram.com": "https://graph.facebook.com/v18.0/instagram_oembed?url=%s",
}


def oembed(url: Column) -> Column:
    """Where a post or video can be asked for as JSON, null for other hosts."""
    out = F.when(F.lit(False), "")
    for name, form in OEMBED.items():
        out = out.when(F.rlike(domain(url), F.lit("(^|\\.)" + name.replace(".", "\\.") + "$")), F.format_string(form, encoded(url)))
    return out


def encoded(text: Column) -> Column:
    """Text as a part of a query string, blanks as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
