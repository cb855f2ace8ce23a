"""Validity, rejection and quality of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clamp(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 2)


def is_valid(title: Column, url: Column, summary: Column, text: Column) -> Column:
    """A title of 5 characters, a web URL, and a summary of 20 or a text of 100."""
    size = lambda c: F.coalesce(F.length(F.trim(c)), F.lit(0))
    return (size(title) >= 5) & F.coalesce(F.startswith(url, F.lit("http")), F.lit(False)) & ((size(summary) >= 20) | (size(text) >= 100))


def matches_any(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(F.rlike(text, F.lit("(?i)" + "|".join(patterns))), F.lit(False))


def rejection(text: Column, families: list[tuple[str, str]]) -> Column:
    """The first family whose pattern the text matches, null if none."""
    out = F.when(F.lit(False), "")
    for name, pattern in families:
        out = out.when(F.rlike(text, F.lit("(?i)" + pattern)), name)
    return out


def quality_by_shape(title: Column, summary: Column, category: Column, bias: Column, is_press: Column, good: list[str], poor: list[str]) -> Column:
    """0.7, adjusted for lengths, category, press releases and extreme bias."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return clamp(
        0.7
        - F.when(size(title) < 30, 0.15).when(size(title) > 80, 0.05).otherwise(0.0)
        + F.when(size(summary) < 50, -0.25).when(size(summary) > 300, 0.1).otherwise(0.0)
        + F.when(category.isin(good), 0.05).when(category.isin(poor), -0.1).otherwise(0.0)
        - F.when(is_press, 0.35).otherwise(0.0)
        - F.when(F.abs(F.coalesce(bias, F.lit(0.0))) > 0.7, 0.15).otherwise(0.0)
    )


def quality_by_parts(body: Column, image: Column, summary: Column, bias: Column) -> Column:
    """0.5 and bonuses for a long body, an image, a summary and low bias."""
    size = F.coalesce(F.length(body), F.lit(0))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    return clamp(
        0.5
        + F.when(size > 2000, 0.2).when(size > 500, 0.1).otherwise(0.0)
        + F.when(given(image), 0.15).otherwise(0.0)
        + F.when(given(summary), 0.05).otherwise(0.0)
        + F.when(F.abs(F.coalesce(bias, F.lit(0.0))) < 0.3, 0.1).otherwise(0.0)
    )


def quality_by_body(body: Column, press: str) -> Column:
    """Steps by length, lowest for press releases."""
    return F.when(body.isNull() | (F.length(body) < 100), 0.2).when(F.rlike(body, F.lit("(?i)" + press)), 0.1).when(F.length(body) > 500, 0.8).otherwise(0.5)


#: Titles that name no article.
GENERIC_TITLES = ("article", "home", "untitled", "news", "index")


def usable(title: Column, summary: Column, garbage: list[str], least: int = 30) -> Column:
    """Enough text without its tags, no sign of an error page, and a title that says something."""
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", ""))
    return (F.length(plain(summary)) >= least) & ~matches_any(F.concat_ws(" ", plain(title), plain(summary)), garbage) & ~F.lower(plain(title)).isin(*GENERIC_TITLES)


def rejected_shape(quality: Column, rejection: Column, is_press: Column) -> Column:
    """A quality score after rejection, which makes it 0.1, and the press-release detector, which takes 0.25."""
    return F.when(rejection.isNotNull(), 0.1).otherwise(clamp(quality - F.when(is_press, 0.25).otherwise(0.0)))


def rejected_titles(items: DataFrame, keywords: list[str], least: int, days: int) -> DataFrame:
    """(id, reason) of items (id, title, body, day): a keyword in the title, a short body, a title that an earlier item of the last ``days`` had.

    Titles are compared by digest and day: one row per title and day is kept, however many
    items have it, so no title's items meet in a task.
    """
    named = items.withColumn("digest", F.md5("title"))
    seen = named.groupBy("digest", "day").agg(F.min("id").alias("first_id"))
    later = seen.select("digest", "first_id", F.col("day").alias("seen_on"), F.explode(F.sequence(F.col("day"), F.col("day") + days)).alias("day"))
    before = later.groupBy("digest", "day").agg(F.max(F.col("seen_on") < F.col("day")).alias("earlier"), F.min(F.when(F.col("seen_on") == F.col("day"), F.col("first_id"))).alias("first_id"))
    reason = F.when(F.lit(False), "")
    for word in keywords:
        reason = reason.when(F.contains("title", F.lit(word)), f"keyword:{word}")
    reason = reason.when(F.length("body") < least, F.concat(F.lit("short:"), F.length("body").cast("string")))
    judged = named.select("id", "digest", "day", reason.alias("reason"))
    repeated = F.when(F.col("earlier") | (F.col("id") > F.col("first_id")), "duplicate title")
    return judged.join(before, ["digest", "day"]).select("id", F.coalesce("reason", repeated).alias("reason"))
