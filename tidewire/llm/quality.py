"""Quality rules with thresholds learned from quantile sketches.

Each document is measured with column functions alone. Per language and source a mergeable
KLL sketch summarises each measure and the sizes of texts; fences drawn from them replace
fixed cutoffs. A fence stands ``reach`` times the spread of a group's sound part beyond it,
from its median to the quantile up to which documents are taken as sound, and as many cases
further as one text of the group's median size may show by chance. A text shorter than that
is judged as if it were as long. Sketches are built per salt first, so a source with a third
of all rows is summarised by many tasks, and merged again upwards for languages and for the
whole corpus.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACE_CHARS, SPACE_CLASS, cut, join_small, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8


class Measure(NamedTuple):
    """``count`` per ``size``, or a mean of its own if there is none."""

    #: The quantile up to which a group's documents are taken as sound. Symbols come in a part of the texts of
    #: every scraped source, repetition in the last hundredth of sound ones too.
    sound: float
    count: str | None = None
    size: str | None = None
    #: Cases that a sound text may show by chance.
    cases: int = 0


MEASURES = {
    "symbol_rate": Measure(0.75, "n_symbols", "n_words", 3),
    "word_length": Measure(0.9),
    "dup_line_share": Measure(0.99, "n_dup_lines", "n_lines", 1),
    "repeat_share": Measure(0.99, "n_repeat_words", "n_words", 3 * WINDOW),
}
#: Measures of which too small a value is as odd as too large a one.
TWO_SIDED = ("word_length",)
SIZES = ("n_words", "n_lines")


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+", -1), lambda w: w != "")


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words stand in a window of ``width`` words that the same text holds twice or more."""

    def of_windows(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twins(r: Column) -> Column:
            n = F.size(r)
            same = lambda x, j: (j >= 0) & (j < n) & (F.get(r, j)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(r, lambda x, i: F.coalesce(same(x, i - 1) | same(x, i + 1), F.lit(False))), lambda x: x["i"]))

        def covered(p: Column) -> Column:
            steps = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ranked, twins), covered))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.xxhash64(F.slice(w, i, width)))

    return F.when(F.size(words) < width, F.lit(0)).otherwise(let(words, lambda w: let(windows(w), of_windows)))


def measure(docs: DataFrame) -> DataFrame:
    """The base counts of every document and the rates that are compared within a source."""
    text = F.col("text").cast("string")
    parts = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).withColumns(
        {
            "words": words_of(F.col("text")),
            "lines": F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACE_CHARS, "") != ""),
        }
    )
    long = lambda c: c.cast("long")
    counts = parts.select(
        "doc_id",
        "lang",
        "source",
        F.xxhash64("text").alias("text_hash"),
        long(F.size("words")).alias("n_words"),
        long(F.length(F.translate("text", SPACE_CHARS, ""))).alias("word_chars"),
        long(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(repeated_words(F.col("words"))).alias("n_repeat_words"),
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return counts.withColumns(
        {
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
            "symbol_rate": rate("n_symbols", "n_words"),
            "word_length": rate("word_chars", "n_words"),
            "dup_line_share": rate("n_dup_lines", "n_lines"),
            "repeat_share": rate("n_repeat_words", "n_words"),
        }
    )


def sketches(measured: DataFrame, k: int = 800, salts: int = 64) -> DataFrame:
    """One KLL sketch per language, source and measure or size over the documents that pass the base rules."""
    salted = measured.filter(~F.col("base_failed")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(salts)))
    part = salted.groupBy("lang", "source", "salt").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(F.col(m).cast("double"), F.lit(k)).alias(m) for m in (*MEASURES, *SIZES)])
    return merge_sketches(part, "lang", "source")


def merge_sketches(part: DataFrame, *keys: str) -> DataFrame:
    return part.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in (*MEASURES, *SIZES)])


def thresholds(sketched: DataFrame, least: int = 30, reach: float = 3.0) -> DataFrame:
    """Fences (low, high, and the median size that short texts are judged by) per language, source and measure.

    Sources with fewer than ``least`` passing documents take their language's sketch, and
    languages with fewer take that of the corpus.
    """

    def fences(frame: DataFrame, tag: str, *keys: str) -> DataFrame:
        def of(name: str, m: Measure) -> Column:
            typical = F.kll_sketch_get_quantile_double(m.size, F.lit(0.5)) if m.size else F.lit(None).cast("double")

            def fence(q: Column) -> Column:
                low = q[1] - reach * (q[0] - q[1]) if name in TWO_SIDED else F.lit(None).cast("double")
                by_chance = m.cases / typical if m.size else F.lit(0.0)
                return F.struct(low.alias("low"), (q[2] + reach * (q[2] - q[0]) + by_chance).alias("high"), typical.alias("typical"))

            return let(F.kll_sketch_get_quantile_double(name, F.array(F.lit(0.5), F.lit(1 - m.sound), F.lit(m.sound))), fence).alias(name)

        return frame.select(*keys, F.struct(F.col("n"), *[of(name, m) for name, m in MEASURES.items()]).alias(tag))

    by_lang = merge_sketches(sketched, "lang")
    overall = fences(merge_sketches(by_lang.withColumn("everything", F.lit(1)), "everything"), "of_all", "everything").drop("everything")
    joined = fences(sketched, "of_source", "lang", "source").join(fences(by_lang, "of_lang", "lang"), "lang").join(F.broadcast(overall))  # one row
    chosen = F.when(F.col("of_source.n") >= least, F.col("of_source")).when(F.col("of_lang.n") >= least, F.col("of_lang")).otherwise(F.col("of_all"))
    return joined.select("lang", "source", chosen.alias("fence"))


def judged(measured: DataFrame, fences: DataFrame) -> DataFrame:
    """``measured`` with its fences and the column kept. Sources are few: their table is broadcast if it proves small."""
    odd = F.lit(False)
    for name, m in MEASURES.items():
        fence = F.col("fence")[name]
        value = F.col(m.count) / F.greatest(F.col(m.size), fence["typical"]) if m.count else F.col(name)
        odd = odd | (value > fence["high"])
        if name in TWO_SIDED:
            odd = odd | (value < fence["low"])
    kept = ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False))
    return join_small(measured, fences, ["lang", "source"], "left").withColumn("kept", kept)


def quality_rules(docs: DataFrame, k: int = 800, least: int = 30, reach: float = 3.0) -> DataFrame:
    """Counts, base rules and adaptive verdict, one row per row of ``docs``.

    Null text has no words and fails the base rules, as does empty text. Null language or
    source is a group of its own. Repeated rows are measured and summarised one by one. With
    no passing document in a group there is nothing to reject by. Ties at a fence pass. An
    empty table gives no rows. Other columns are ignored.

    ``k`` is the sketches' size (at most k rows: exact), ``least`` the rows a group needs for
    fences of its own, ``reach`` the spreads to a fence.
    """
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    measured = cut(measure(docs))
    fences = cut(thresholds(sketches(measured, k), least, reach))
    return judged(measured, fences).select(*base, *MEASURES)


def filter_quality(docs: DataFrame, k: int = 800, least: int = 30, reach: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with all their columns, whatever their names.

    Null and empty texts go, as they fail the base rules; repeated rows share a verdict, and
    null languages, sources and doc_ids are values of their own. An empty table gives no rows.
    Texts are measured once; the keys of rejected rows are taken out of ``docs``, by broadcast
    if their table proves small.
    """
    measured = cut(measure(docs))
    fences = cut(thresholds(sketches(measured, k), least, reach))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id")
    key = ["id", "text_hash", "lang", "source"]
    bad = cut(judged(measured, fences).filter("not kept").select(named, *key[1:]).distinct())
    frame = docs.select(F.struct("*").alias("row"), named, F.xxhash64(text("text")).alias("text_hash"), text("lang").alias("lang"), text("source").alias("source"))
    return join_small(frame, bad, key, "left_anti", row_bytes=96).select("row.*")
