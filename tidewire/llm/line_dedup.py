"""Repeated runs of lines, found by winnowing over line hashes.

A run of lines counts if it has ``w`` lines, or ``least_words`` words in fewer. A window is
the shortest such run from a line on; of every window the line with the smallest hash is a
fingerprint, so any run that occurs twice has a fingerprint in common. The positions of
fingerprints that occur more than once are joined with the windows around them, windows of
equal content are matched with the first of their kind in (doc_id, line) order, and matches
that go on line by line, in the text and in the earlier one, are extended both ways into one
as long as both agree. The later runs are deleted. Windows are grouped by their content
instead of compared pair by pair, so a line that a third of all documents share costs one row
per occurrence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.common import cut, join_small, let, text_or_empty

WORD = "[^\\x20\\x09-\\x0D]+"
#: Lines of a run that counts, and words of one that counts with fewer lines.
LINES, WORDS = 3, 50


def line_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, lines, words): 128-bit digests of a document's lines, white space at their ends ignored, and their numbers of words."""
    split = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), F.split(text_or_empty(), "\n", -1).alias("lines"))
    digests = F.transform("lines", lambda x: F.unhex(F.md5(F.trim(x))))
    return split.select("doc_id", "text_hash", digests.alias("lines"), F.transform("lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("words"))


def _windows(words: Column, w: int, least_words: int) -> Column:
    """Per line the number of lines of the window that begins there, 0 if too few follow."""
    n = F.size(words)

    def at(i: Column) -> Column:
        size = F.lit(None).cast("int")
        for k in range(1, w):
            held = reduce(Column.__add__, [F.coalesce(F.get(words, i + j), F.lit(0)) for j in range(k)])
            size = F.coalesce(size, F.when((i + k <= n) & (held >= least_words), k))
        return F.coalesce(size, F.when(i + w <= n, w), F.lit(0))

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def fingerprints(hashed: DataFrame, w: int, least_words: int) -> DataFrame:
    """(print, doc_id, text_hash, first, around, windows): window minima, with the w - 1 lines on either side.

    ``first`` is the number of the first line in ``around``; ``windows`` are the sizes of the
    windows that begin there, or later, at the fingerprint at last. Of equal minima the last in
    the window is taken.
    """

    def rows(h: Column, sizes: Column) -> Column:
        def least(x: Column, i: Column) -> Column:
            window = F.slice(h, i + 1, x)
            return F.when(x > 0, i + x - F.array_position(F.reverse(window), F.array_min(window)).cast("int"))

        def row(p: Column) -> Column:
            first = F.greatest(p - (w - 1), F.lit(0))
            around, windows = F.slice(h, first + 1, p + w - first), F.slice(sizes, first + 1, p - first + 1)
            return F.struct(F.get(h, p).alias("print"), first.alias("first"), around.alias("around"), windows.alias("windows"))

        return F.transform(F.array_distinct(F.array_compact(F.transform(sizes, least))), row)

    found = let(_windows(F.col("words"), w, least_words), lambda sizes: rows(F.col("lines"), sizes))
    return hashed.select("doc_id", "text_hash", F.explode(found).alias("x")).select("x.print", "doc_id", "text_hash", "x.first", "x.around", "x.windows")


def repeated_runs(hashed: DataFrame, w: int, least_words: int) -> DataFrame:
    """(doc_id, text_hash, start, end): the longest runs of lines that an earlier place holds too, lines start to end - 1."""
    prints = cut(fingerprints(hashed, w, least_words))
    shared = cut(prints.groupBy("print").agg(F.count("*").alias("n")).filter("n > 1").select("print"))
    joined = join_small(prints, shared, "print", "left_semi", row_bytes=32)

    def match(x: Column, i: Column) -> Column:
        run = F.unhex(F.md5(F.array_join(F.transform(F.slice("around", i + 1, x), F.hex), "")))
        # A window that ends before the fingerprint belongs to another.
        return F.when((x > 0) & (i + x >= F.size("windows")), F.struct((F.col("first") + i).alias("start"), (F.col("first") + i + x).alias("end"), run.alias("run")))

    found = F.array_compact(F.transform("windows", match))
    # A window may hold several fingerprints; each place counts once.
    matched = cut(joined.select("doc_id", "text_hash", F.explode(found).alias("x")).select("x.run", "doc_id", "text_hash", "x.start", "x.end").distinct())
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("start").alias("start"))
    first = cut(matched.groupBy("run").agg(F.min(place).alias("earliest"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    later = join_small(matched, first, "run", "inner", row_bytes=64).filter(place > F.col("earliest"))
    # Windows that follow each other here and in the earlier text are one match, extended line by line.
    text = ["doc_id", "text_hash", "source", "shift"]
    aligned = later.select("doc_id", "text_hash", F.col("earliest.doc_id").alias("source"), (F.col("start") - F.col("earliest.start")).alias("shift"), "start", "end")
    in_order = Window.partitionBy(*text).orderBy("start")
    fresh = F.coalesce(F.col("start") > F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = aligned.withColumn("fresh", fresh).withColumn("match", F.count_if("fresh").over(in_order))
    return numbered.groupBy(*text, "match").agg(F.min("start").alias("start"), F.max("end").alias("end")).select("doc_id", "text_hash", "start", "end")


def _kept_lines() -> Column:
    gone = F.flatten(F.transform("runs", lambda s: F.sequence(s["start"], s["end"] - 1)))
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone))
    return F.when(F.col("runs").isNull(), F.col("lines")).otherwise(let(F.col("lines"), lambda x: F.transform(kept, lambda i: F.get(x, i))))


def without_repeats(docs: DataFrame, w: int = LINES, least_words: int = WORDS) -> DataFrame:
    """Each row of ``docs`` in the struct ``row``, its ``lines``, and ``kept``: the lines outside repeated runs."""
    found = repeated_runs(cut(line_hashes(docs)), w, least_words)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    runs = cut(found.groupBy(key.alias("key"), "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("runs")))
    frame = docs.select(F.struct("*").alias("row"), key.alias("key"), F.xxhash64(text_or_empty()).alias("text_hash"), F.split(text_or_empty(), "\n", -1).alias("lines"))
    # Texts are not shuffled while the documents that lose lines are few.
    n, runs_of = runs.agg(F.count("*"), F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()
    return join_small(frame, runs, ["key", "text_hash"], "left", row_bytes=64 + 16 * runs_of // max(n, 1)).select("row", "lines", _kept_lines().alias("kept"))


def line_dedup(docs: DataFrame, w: int = LINES, least_words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, text and text_sha256 of what is left, one row per row of ``docs``.

    A line goes if it stands in a run of ``w`` lines, or of ``least_words`` words in fewer
    lines, that occurs earlier: in a document with a smaller doc_id, or higher up in its own.
    Runs may overlap. Lines are compared without the spaces at their ends. Null text counts as
    empty, which is one empty line. A null doc_id comes after all others. Rows that repeat a
    doc_id and its text are one document, none of them later than the other. An empty table
    gives no rows.
    """
    left = without_repeats(docs.select("doc_id", "text"), w, least_words)
    text = F.array_join("kept", "\n")
    return left.select(F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), text.alias("text")).withColumn("text_sha256", F.sha2("text", 256))


def drop_repeated_lines(docs: DataFrame, w: int = LINES, least_words: int = WORDS) -> DataFrame:
    """``docs`` with repeated runs cut out of text, as line_dedup finds them.

    Documents of which nothing is left go; untouched rows stay as they are, null and empty
    texts and repeated rows too. Columns may have any names. An empty table gives no rows.
    """
    left = without_repeats(docs, w, least_words)
    touched = F.size("kept") < F.size("lines")
    text = F.when(touched, F.array_join("kept", "\n")).otherwise(F.col("row.text"))
    columns = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns]
    return left.filter(~touched | (F.size("kept") > 0)).select(*columns)
