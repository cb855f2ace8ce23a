"""Groups of spelling variants by an index of variable-length grams.

A dictionary holds the grams that stand in many words, up to ``longest`` characters. At every
position of a word, its end marks included, its gram is the shortest that the dictionary does
not hold: common beginnings are told apart by longer grams. What a gram is depends on its own
characters only, so an inserted, deleted or replaced character affects no gram but those that
cover it. A word's bound is the largest number of grams that one place lies in.

Two words one change apart share all other grams at the same distance from the beginning or
from the end. However a word's grams are ordered, at most as many as its bound come before
the first that it shares; so lists of only the bound + 1 rarest grams of each word are
merged. What meets in a list is verified character by character.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import column, small_batches
from tidewire.llm.common import cut, join_small, release, text_or_empty

LETTERS = "A-Za-zÀ-ÿ"
#: Marks around a word; no letters.
BEGIN, END = "<", ">"


def word_counts(docs: DataFrame, letters: str, least_chars: int, altered: Callable[[object, str], str] | None, most: int = 200_000) -> DataFrame:
    """(word, n) over all texts; at most about ``most`` words are counted in a task before they are given out."""
    found = re.compile(f"[{letters}]{{{least_chars},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for part in small_batches(batches):
            for doc_id, text in zip(column(part, "doc_id").to_pylist(), column(part, "text").to_pylist(), strict=True):
                lower = text.lower() if text.isascii() else text.encode().lower().decode()
                words = Counter(found(lower))
                if altered:
                    for word, n in words.items():
                        total[altered(doc_id, word)] += n
                else:
                    total.update(words)
                if len(total) > most:
                    yield counted()
                    total.clear()
        if total:
            yield counted()

    counts = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.length("word") >= least_chars)


def common_grams(words: DataFrame, shortest: int, longest: int, most: int) -> dict[str, int]:
    """The grams, ``shortest`` to ``longest`` characters, that stand in words more often than one in ``most`` places, with their number.

    So there are fewer than ``most`` of each length, however many words there are.
    """
    marked = F.concat(F.lit(BEGIN), "word", F.lit(END))
    places = words.select(marked.alias("word"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("at"))
    grams = places.select(F.explode(F.expr(f"transform(filter(sequence({shortest}, {longest}), n -> at + n <= length(word) + 1), n -> substr(word, at, n))")).alias("gram"))
    n_places = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(20, n_places // most)
    return {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") > least).collect()}


def decomposed(word: str, common: dict[str, int], shortest: int, longest: int) -> list[str]:
    """The gram at every position of the marked word."""
    text = BEGIN + word + END
    grams = []
    for at in range(len(text) - shortest + 1):
        end = at + shortest
        while end < len(text) and end - at < longest and text[at:end] in common:
            end += 1
        grams.append(text[at:end])
    return grams


def affected(grams: list[str]) -> int:
    """The most grams that one changed character can affect: those that cover one place."""
    change = [0] * (len(grams) + max(map(len, grams)) + 1)
    for at, gram in enumerate(grams):
        change[at] += 1
        change[at + len(gram)] -= 1
    most = covering = 0
    for c in change:
        covering += c
        most = max(most, covering)
    return most


def listed(word: str, common: dict[str, int], shortest: int, longest: int) -> list[tuple[int, str]]:
    """(position, gram) of the grams that stand for the word in the index, rarest first."""
    grams = decomposed(word, common, shortest, longest)
    order = sorted(range(len(grams)), key=lambda at: (common.get(grams[at], 0), grams[at], at))
    return [(at, grams[at]) for at in order[: affected(grams) + 1]]


def near_words(words: DataFrame, least_chars: int = 6, shortest: int = 2, longest: int = 6, most: int = 50_000, crowd: int = 2000) -> DataFrame:
    """(word, n, other, other_n): both directions of all pairs one inserted, deleted or replaced character apart.

    ``words`` is (word, n), written, of at least ``least_chars`` characters each. A list of
    over ``crowd`` words is not merged in pairs: its words meet under their variants with one
    character left out or open.
    """
    if longest > least_chars:
        raise ValueError("a word must have a gram more than one change can affect")
    spark = words.sparkSession
    common = spark.sparkContext.broadcast(common_grams(words, shortest, longest, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            picks, keys = [], []
            for row, word in enumerate(column(part, "word").to_pylist()):
                for at, gram in listed(word, common.value, shortest, longest):
                    picks.append(row)
                    keys.append(f"{at} {len(word)} {gram}")
            picked = part.take(pa.array(picks, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(keys, pa.string())], ["word", "n", "list"])

    entries = cut(words.select("word", "n").mapInArrow(run, "word string, n long, list string").select("word", "n", F.split("list", " ", 3).alias("x")).select("word", "n", F.col("x")[0].cast("int").alias("at"), F.col("x")[1].cast("int").alias("size"), F.col("x")[2].alias("gram")))
    key = ["gram", "size", "at"]
    large = cut(entries.groupBy(*key).agg(F.count("*").alias("held")).filter(F.col("held") > crowd).select(*key))
    # The other word of a pair is as long and has the gram at the same place, or has one more and the gram there or one behind.
    shifted = F.explode(F.array(F.struct("size", "at"), F.struct((F.col("size") + 1).alias("size"), "at"), F.struct((F.col("size") + 1).alias("size"), (F.col("at") + 1).alias("at"))))
    probes = entries.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "gram", F.col("size").alias("own_size"), shifted.alias("x")).select("other", "other_n", "gram", "own_size", "x.*")
    lists = entries
    crowded = None
    if not large.isEmpty():
        lists = join_small(entries, large, key, "left_anti", row_bytes=64)
        probes_of = join_small(probes, large, key, "left_semi", row_bytes=64)
        probes = join_small(probes, large, key, "left_anti", row_bytes=64)
        members = join_small(entries, large, key, "left_semi", row_bytes=64).select("word", "n").union(probes_of.select("other", "other_n")).distinct()
        crowded = one_apart(members)
    pairs = probes.join(lists, key).filter((F.col("own_size") < F.col("size")) | (F.col("other") < F.col("word")))
    pairs = pairs.filter(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    if crowded is not None:
        pairs = pairs.union(crowded)
    both = cut(pairs.distinct())
    release(entries, large)
    return both.union(both.select("other", "other_n", "word", "n"))


def one_apart(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): each pair of ``words`` (word, n) one change apart, by equal variants without one character."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    left_out = words.select("word", "n", at).select("word", "n", "at", F.concat(F.expr("substr(word, 1, at - 1)"), F.expr("substr(word, at + 1)")).alias("variant"))
    other = left_out.select(F.col("word").alias("other"), F.col("n").alias("other_n"), "at", "variant")
    replaced = left_out.join(other, ["variant", "at"]).filter("other < word").select("word", "n", "other", "other_n")
    whole = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    deleted = left_out.join(whole, F.col("variant") == F.col("other")).select("word", "n", "other", "other_n")
    return replaced.union(deleted)


def roots_of(forms: DataFrame, ratio: int) -> DataFrame:
    """(word, root): where the forms (word, form, form_n) of each word lead in the end.

    Every step leads to a word at least ``ratio`` times as frequent, so the longest way is
    short; each round doubles the steps taken.
    """
    most = forms.agg(F.max("form_n")).first()[0] or 0
    steps, left = 1, most // ratio
    while left > 0:
        left //= ratio
        steps += 1
    roots = cut(forms.select("word", F.col("form").alias("root")))
    taken = 1
    while taken < steps:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = cut(join_small(roots, ahead, "root", "left", row_bytes=80).select("word", F.coalesce("next", "root").alias("root")))
        release(roots)
        roots, taken = further, 2 * taken
    return roots


def spelling_variants(docs: DataFrame, letters: str = LETTERS, least_chars: int = 6, least_n: int = 5, ratio: int = 5, altered: Callable[[object, str], str] | None = None, **index) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the corpus.

    Words are maximal runs of ``letters``, A-Z in lower case, of at least ``least_chars``
    characters and ``least_n`` occurrences. Words are near if one inserted, deleted or
    replaced character makes them equal. The form is the near word with the largest n, of
    equals the smallest, if that n is at least ``ratio`` times the word's; else it is null.
    The root is where following forms ends. ``altered`` (doc_id, word) may change words first.

    Null texts have no words. Repeated rows count one by one. A null doc_id only matters to
    ``altered``. An empty table gives no rows. Other columns are ignored.
    """
    words = cut(word_counts(docs, letters, least_chars, altered).filter(F.col("n") >= least_n))
    near = near_words(words, least_chars, **index)
    first = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    found = cut(near.groupBy("word").agg(F.count("*").alias("n_near"), first.alias("first")))
    judged = words.join(found, "word", "left")
    is_form = -F.col("first.less") >= ratio * F.col("n")
    judged = judged.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("first.form")).alias("form"), F.when(is_form, -F.col("first.less")).alias("form_n"))
    judged = cut(judged)
    roots = roots_of(judged.filter("form is not null"), ratio)
    out = join_small(judged, roots, "word", "left", row_bytes=80)
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
