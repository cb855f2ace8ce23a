"""Ranked text search in one pass, cosines and nearest prototypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import normalise
from tidewire.operators.steps import written


def bm25(docs: DataFrame, terms: list[str], most: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the documents of (id, text) that hold every term, the best ``most`` of them.

    One pass over the texts writes each document's length and how often it has the query's
    terms; the corpus statistics, one row, and the scores are made of that.
    """
    words = docs.select("id", F.split(normalise(F.coalesce("text", F.lit(""))), " ", -1).alias("words"))
    tf = lambda t: F.size(F.filter("words", lambda w: w == t))
    counted = written(words.select("id", F.size("words").alias("length"), *[tf(t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * F.col("length") / F.col("mean")))

    every = F.lit(True)
    for i in range(len(terms)):
        every = every & (F.col(f"tf{i}") > 0)
    scored = joined.filter(every).select("id", F.round(sum((part(i) for i in range(1, len(terms))), part(0)), 4).alias("score"))
    return scored if most is None else scored.orderBy(F.desc("score"), "id").limit(most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-9)


def nearest_label(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(id, label, score): the prototype (label, vector) with the highest cosine. Prototypes are one row of at most a few hundred."""
    together = prototypes.agg(F.collect_list(F.struct("label", F.col("vector").alias("p"))).alias("all"))
    best = F.array_max(F.transform("all", lambda x: F.struct(F.round(cosine(F.col("vector"), x["p"]), 6).alias("s"), (-x["label"]).alias("l"))))
    return vectors.crossJoin(F.broadcast(together)).select("id", best.alias("b")).select("id", (-F.col("b.l")).alias("label"), F.round(F.col("b.s"), 4).alias("score"))  # one row


def prototypes(vectors: DataFrame, label: str, size: int) -> DataFrame:
    """The mean vector of each label."""
    return vectors.groupBy(label).agg(F.array(*[F.avg(F.get("vector", F.lit(i)).cast("double")) for i in range(size)]).alias("vector"))
