"""Text as columns: folding, tokens, cleaning, ids."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Accented Latin letters and their plain forms.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"
# White space, and what words are made of. Java looks single characters of a class up in a table; ranges and \s are tried one after another at each character.
SPACES = r" \t\n\x0B\f\r"
WORDLY = "abcdefghijklmnopqrstuvwxyz0123456789_"

# Character references that feeds use, in the order in which they are replaced.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#8230;", "..."), ("&#8217;", "'"), ("&#8220;", '"'), ("&#8221;", '"'), ("&#8216;", "'"), ("&#8211;", "-"), ("&#8212;", "—"))


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def normalise(text: Column) -> Column:
    """Folded words of a-z, 0-9 and _ with single spaces; anything else but white space is dropped."""
    return F.trim(single_spaces(F.regexp_replace(fold(text), f"[^{WORDLY}{SPACES}]+", "")))


def single_spaces(text: Column) -> Column:
    """Runs of white space as one space each; a space that stands alone is not replaced."""
    return F.regexp_replace(text, rf"[{SPACES[1:]}][{SPACES}]*| [{SPACES}]+", " ")


def words(text: Column) -> Column:
    """The normalised words of a text, none of null."""
    return F.filter(F.split(normalise(F.coalesce(text, F.lit(""))), " ", -1), lambda w: w != "")


def significant_words(text: Column, least: int = 3) -> Column:
    """The different normalised words of ``least`` letters or more, in order of appearance."""
    return F.array_distinct(F.filter(F.split(normalise(text), " ", -1), lambda w: F.length(w) >= least))


def signature(text: Column, size: int = 6) -> Column:
    """The ``size`` longest significant words (of equals the first in the alphabet), sorted and joined by |."""
    ranked = F.array_sort(F.transform(significant_words(text), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    return F.array_join(F.array_sort(F.transform(F.slice(ranked, 1, size), lambda x: x["w"])), "|")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets, 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def strip_tags(html: Column, by: str = "") -> Column:
    return F.regexp_replace(html, "<[^>]*>", by)


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


# Names of networks whose links follow a text, and what ends or interrupts it.
SOCIAL_NAMES = ("Facebook", "Twitter", "Instagram", "LinkedIn", "YouTube", "TikTok")
READ_MORE = ("Leer más",)


def clean_html(html: Column, social: tuple[str, ...] = SOCIAL_NAMES, read_more: tuple[str, ...] = READ_MORE) -> Column:
    """Plain text of a snippet: no tags, no references, no links to ``social`` networks, empty brackets or ``read_more`` phrases, nothing from "The post" on, single spaces."""
    either = lambda names: "|".join(re.escape(n) for n in names)
    text = F.regexp_replace(html, rf"(?i)\[(?:{either(social)})[^\]]*\]\([^)]*\)", "") if social else html
    text = unescape(strip_tags(F.replace(text, F.lit("[]"), F.lit(""))))
    text = F.regexp_replace(text, r"(?s)The post.*", "")
    if read_more:
        text = F.regexp_replace(text, rf"(?iu)\s*(?:{either(read_more)})\s*", "")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def excerpt(text: Column, target: int = 280, slack: int = 20, least: int = 100, dotted_from: int = 50) -> Column:
    """Whole sentences up to about ``target`` characters, ... behind more than ``dotted_from`` if something is left out."""
    # What no sign ends is found as one piece and left out; else it would be searched again from each of its characters.
    pieces = F.slice(F.regexp_extract_all(text, F.lit(r"[^.!?]*+(?:[.!?]++|\z)"), F.lit(0)), 1, max(target + slack, least) + 2)
    found = F.filter(pieces, lambda s: F.right(s, F.lit(1)).isin(".", "!", "?"))
    # A value named twice would be computed twice. Each sentence adds a character at least, so none behind these can be taken.
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))
    sentences = once(found, lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(text)))

    def take(acc: Column, s: Column) -> Column:
        full = acc["full"] | ((F.length(acc["out"]) + F.length(s) > target + slack) & (F.length(acc["out"]) > least))
        grown = F.concat(acc["out"], F.when(acc["out"] == "", "").otherwise(" "), F.trim(s))
        return F.struct(F.when(full, acc["out"]).otherwise(grown).alias("out"), full.alias("full"))

    begin = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))
    dotted = F.aggregate(sentences, begin, take, lambda acc: F.when((F.length(acc["out"]) < F.length(text)) & (F.length(acc["out"]) > dotted_from), F.concat(acc["out"], F.lit("..."))).otherwise(acc["out"]))
    return once(dotted, lambda d: F.when(d == "", text).otherwise(d))


def sentences(text: Column, least: int = 10) -> Column:
    """Trimmed sentences of more than ``least`` characters."""
    return F.filter(F.transform(F.split(text, "[.!?]+", -1), lambda s: F.trim(single_spaces(s))), lambda s: F.length(s) > least)


def sentence_key(sentence: Column, width: int = 80) -> Column:
    return F.left(normalise(sentence), F.lit(width))


def slug(text: Column) -> Column:
    return F.regexp_replace(fold(F.trim(text)), r"\s+", "-")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substring(text, 2, 1_000_000)))


def initials(name: Column, words: int = 2) -> Column:
    """First letters of the first words."""
    return F.upper(F.array_join(F.transform(F.slice(F.split(F.trim(name), r"\s+", -1), 1, words), lambda w: F.left(w, F.lit(1))), ""))


def csv_ids(text: Column) -> Column:
    """The numbers of a comma-separated list; blanks and anything else are left out."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), lambda s: F.trim(s))
    return F.transform(F.filter(parts, lambda s: F.rlike(s, F.lit("^[0-9]+$"))), lambda s: s.cast("bigint"))


def highlight(text: Column, terms: list[str]) -> Column:
    """The terms, which are plain text, between marks."""
    return F.regexp_replace(text, "(?i)(" + "|".join(re.escape(t) for t in terms) + ")", "<mark>$1</mark>")


def short_id(text: Column, size: int) -> Column:
    return F.left(F.md5(text.cast("binary")), F.lit(size))


def cache_key(url: Column) -> Column:
    """16 hex digits of the URL's SHA-256, taken in lower case without slashes at its end."""
    return F.left(F.sha2(F.lower(F.regexp_replace(url, "/+$", "")).cast("binary"), 256), F.lit(16))


def url_uuid(url: Column) -> Column:
    """The version 5 UUID of a URL, as a name in the standard URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(url, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def salvaged_json(reply: Column, schema: str) -> Column:
    """The JSON object between the first { and the last } of a model's reply, null if there is none that parses."""
    return F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def canonical_query(params: Column) -> Column:
    """A map as a query string: sorted keys, no empty values."""
    used = F.filter(F.array_sort(F.map_entries(params)), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.array_join(F.transform(used, lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"]))), "&")


def percent(part: Column, whole: Column) -> Column:
    """To one decimal, 0 of nothing."""
    return F.coalesce(F.round(F.try_divide(part.cast("double") * 100, whole.cast("double")), 1), F.lit(0.0))


def csv_count(listed: Column) -> Column:
    """Entries of a comma-separated list that are not blank."""
    return F.size(F.filter(F.split(F.coalesce(listed, F.lit("")), ",", -1), lambda s: F.trim(s) != ""))


@F.pandas_udf(StringType())
def to_ascii(texts: pd.Series) -> pd.Series:
    """Letters without their marks (canonical decomposition); what is then not ASCII is dropped. Each different value of a batch is decomposed once."""
    values = {t: unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode() for t in texts.dropna().unique()}
    return texts.map(values)


def same_letters(a: Column, b: Column) -> Column:
    """Whether two texts are equal but for case and marks, by collation: in the JVM, for any script."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")
