"""Scores of texts from word and phrase lists. Lists are data; terms are folded when they are loaded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.text import fold, normalise


def _terms(terms: list[str]) -> Column:
    return F.array(*[F.lit(t.lower()) for t in terms])


def words_of(text: Column) -> Column:
    """Normalised words: what word hits look at."""
    return F.split(normalise(text), " ", -1)


def word_hits(words: Column, terms: list[str]) -> Column:
    """Terms that are among ``words`` (of words_of)."""
    return F.array_intersect(_terms(terms), words)


def phrase_hits(folded: Column, terms: list[str]) -> Column:
    """Terms that occur anywhere in a folded text."""
    return F.array_compact(F.array(*[F.when(F.contains(folded, F.lit(t.lower())), F.lit(t.lower())) for t in terms]))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however many terms look at it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax_label(scores: dict[str, Column], default: str) -> Column:
    """The label with the highest score above 0; of equals the one listed first."""
    rows = [F.struct(score.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, score) in enumerate(scores.items())]
    return once(F.array_max(F.array(*rows)), lambda best: F.when(best["score"] > 0, best["name"]).otherwise(F.lit(default)))


def category(text: Column, lexicon: dict[str, list[str]], default: str, words: bool = True) -> Column:
    hits, seen = (word_hits, words_of(text)) if words else (phrase_hits, fold(text))
    return once(seen, lambda t: argmax_label({k: F.size(hits(t, v)) for k, v in lexicon.items()}, default))


def title_ladder(title: Column, steps: list[tuple[str, str]], default: str) -> Column:
    """The label of the first term that the folded title contains."""

    def ladder(folded: Column) -> Column:
        label = F.when(F.lit(False), "")
        for term, name in steps:
            label = label.when(F.contains(folded, F.lit(term)), name)
        return label.otherwise(default)

    return once(fold(title), ladder)


def polarity(text: Column, pro: list[str], anti: list[str]) -> Column:
    """(pro - anti) / (pro + anti) over distinct words, 0 without any."""
    hits = once(words_of(text), lambda w: F.struct(F.size(word_hits(w, pro)).alias("pro"), F.size(word_hits(w, anti)).alias("anti")))
    return once(hits, lambda n: F.round(F.coalesce(F.try_divide((n["pro"] - n["anti"]).cast("double"), (n["pro"] + n["anti"]).cast("double")), F.lit(0.0)), 3))


def token_polarity(text: Column, pro: list[str], anti: list[str]) -> Column:
    """Every occurrence counts: 0.1 and 0.15 for each word that one side is ahead, at most 0.9."""
    count = lambda words, terms: F.size(F.filter(words, lambda w: w.isin([t.lower() for t in terms])))
    net = once(words_of(text), lambda w: count(w, pro) - count(w, anti))
    return once(net, lambda n: F.round(F.signum(n.cast("double")) * F.least(F.lit(0.9), 0.1 + F.abs(n) * 0.15), 2))


def framing(text: Column, right: list[str], left: list[str]) -> Column:
    """(score, n, right, left): the share of right among distinct phrases found, 0.5 without any, and the phrases."""
    hits = once(fold(text), lambda t: F.struct(phrase_hits(t, right).alias("right"), phrase_hits(t, left).alias("left")))

    def score(x: Column) -> Column:
        n = F.size(x["right"]) + F.size(x["left"])
        return F.struct(F.coalesce(F.try_divide(F.size(x["right"]).cast("double"), n.cast("double")), F.lit(0.5)).alias("score"), n.alias("n"), x["right"].alias("right"), x["left"].alias("left"))

    return once(hits, score)


def entity_score(text: Column, entities: dict[str, float]) -> Column:
    """Mean score of the entities mentioned, null without any."""
    mean = lambda found: F.try_divide(F.aggregate(found, F.lit(0.0), lambda a, e: a + e["score"]), F.size(found).cast("double"))
    return once(entities_in(text, entities), mean)


def entities_in(text: Column, entities: dict[str, float]) -> Column:
    """(name, score) of the entities mentioned, in the order of the list."""
    row = lambda t, k, v: F.when(F.contains(t, F.lit(k.lower())), F.struct(F.lit(k.lower()).alias("name"), F.lit(v).alias("score")))
    return once(fold(text), lambda t: F.array_compact(F.array(*[row(t, k, v) for k, v in entities.items()])))


def source_prior(source: Column, registry: list[tuple[str, float, float]]) -> Column:
    """(score, confidence) of the first entry that equals, contains or is contained in the source; 0.5 and 0.1 otherwise."""
    out = F.when(F.lit(False), F.struct(F.lit(0.5).alias("score"), F.lit(0.1).alias("confidence")))
    for name, score, confidence in registry:
        out = out.when((source != "") & (F.contains(source, F.lit(name)) | F.contains(F.lit(name), source)), F.struct(F.lit(score).alias("score"), F.lit(confidence).alias("confidence")))
    return out.otherwise(F.struct(F.lit(0.5).alias("score"), F.lit(0.1).alias("confidence")))


def opinion(text: Column, opinion_terms: list[str], news_terms: list[str]) -> Column:
    """(is_opinion, confidence)."""
    hits = once(fold(text), lambda t: F.struct(F.size(phrase_hits(t, opinion_terms)).alias("o"), F.size(phrase_hits(t, news_terms)).alias("n")))
    return once(hits, lambda x: F.struct(((x["o"] > x["n"]) & (x["o"] >= 2)).alias("is_opinion"), F.least(F.lit(1.0), (x["o"] + x["n"]) / 5.0).alias("confidence")))


def fused(signals: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the signals that are not null, 0.5 if none is."""
    total = sum((F.when(s.isNotNull(), F.lit(w)).otherwise(0.0) for s, w in signals), F.lit(0.0))
    score = sum((F.coalesce(s * w, F.lit(0.0)) for s, w in signals), F.lit(0.0))
    return F.coalesce(F.try_divide(score, total), F.lit(0.5))


def side(score: Column) -> Column:
    return F.when(score < 0.25, "left").when(score < 0.42, "centre-left").when(score < 0.58, "centre").when(score < 0.75, "centre-right").otherwise("right")


def fusion_confidence(prior: Column, n_phrases: Column, n_entities: Column) -> Column:
    """How sure a fused score is: half the prior's confidence (null without one), what phrases and entities add, and a bonus for several signals."""
    signals = F.when(prior.isNotNull(), 1).otherwise(0) + F.when(n_phrases > 0, 1).otherwise(0) + F.when(n_entities > 0, 1).otherwise(0)
    parts = F.coalesce(prior * 0.5, F.lit(0.0)) + F.least(F.lit(0.3), n_phrases * 0.1) + F.least(F.lit(0.2), n_entities * 0.05)
    return F.round(F.least(F.lit(1.0), parts + F.when(signals > 1, 0.1).otherwise(0.0)), 2)
