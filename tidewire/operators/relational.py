"""Filters, lookups, counts and rankings of cards and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.labels import bias_band
from tidewire.functions.text import fold, percent
from tidewire.functions.times import ago

#: Time filters and their hours.
SPANS = {"hour": 1, "today": 24, "week": 168, "month": 720}


def all_of(conditions: list[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def card_filter(as_of: str, *, location: int | None = None, category: str | None = None, bias: str | None = None, within: str | None = None, min_quality: float | None = None, sources: list[int] | None = None) -> Column:
    """The conjunction of the filters that are given; an empty list of followed sources filters nothing. Unscored quality counts as 0; categories are compared without case and accents."""
    asked: list[Column] = []
    if location is not None:
        asked.append(F.col("location_id") == location)
    if category is not None:
        asked.append(fold(F.col("category")) == fold(F.lit(category.replace("-", " "))))
    if bias is not None:
        if bias not in ("official", "opposition", "neutral"):
            raise ValueError(f"unknown bias {bias!r}")
        asked.append(F.col("bias_signed").isNotNull() & (bias_band(F.col("bias_signed")) == bias))
    if within is not None:
        asked.append(F.col("created_at") >= ago(as_of, SPANS[within]))
    if min_quality is not None:
        asked.append(F.coalesce(F.col("quality"), F.lit(0.0)) >= min_quality)
    if sources:
        asked.append(F.col("source_id").isin(sources))
    return all_of(asked)


def check_page(limit: int, offset: int) -> None:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, which must be total."""
    check_page(limit, offset)
    return df.orderBy(*order).offset(offset).limit(limit)


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def newest(df: DataFrame, n: int) -> DataFrame:
    return top(df, n, F.desc("created_at"), F.desc("id"))


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Numbers a small ranked result from 1; for whole tables rank within a key."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def first_per(df: DataFrame, n: int, keys: list[str], *order: Column) -> DataFrame:
    """The first ``n`` rows of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n).drop("_rank")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def with_share(counted: DataFrame, name: str = "share") -> DataFrame:
    """Percent of the total for a grouped count: the total is one row, joined back."""
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).withColumn(name, percent(F.col("n"), F.col("total"))).drop("total")  # one row


def bias_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= 0.5, "strong official").when(score > 0.1, "mild official").when(score >= -0.1, "neutral").when(score > -0.5, "mild opposition").otherwise("strong opposition")


def blind_spots(cards: DataFrame, least: int = 2) -> DataFrame:
    """Clusters that one side covers ``least`` times or more and the other not at all, with their newest card."""
    grouped = cards.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("bias_signed") > 0.1).alias("n_official"),
        F.count_if(F.col("bias_signed") < -0.1).alias("n_opposition"),
        F.max_by(F.struct("id", "category"), F.struct("created_at", "id")).alias("newest"),
        F.max("created_at").alias("last_at"),
    )
    one_sided = ((F.col("n_official") >= least) & (F.col("n_opposition") == 0)) | ((F.col("n_opposition") >= least) & (F.col("n_official") == 0))
    return grouped.filter(one_sided).select("cluster_id", "n", "n_official", "n_opposition", F.col("newest.id").alias("id"), F.col("newest.category").alias("category"), "last_at")


def cluster_stats(cards: DataFrame) -> DataFrame:
    """One row: cards, clustered cards, clusters, rate and mean size; groups are aggregated before they are averaged."""
    by_cluster = cards.groupBy("cluster_id").agg(F.count("*").alias("n"))
    inside = F.col("cluster_id").isNotNull()
    return by_cluster.agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("clustered"),
        F.count_if(inside).alias("clusters"),
        percent(F.sum(F.when(inside, F.col("n"))), F.sum("n")).alias("rate"),
        F.round(F.avg(F.when(inside, F.col("n"))), 2).alias("mean_size"),
    )


def without_master(cards: DataFrame, masters: DataFrame, least: int = 2) -> DataFrame:
    """Clusters of ``least`` cards or more that have no master article, with their sizes."""
    grouped = counts_by(cards.filter(F.col("cluster_id").isNotNull()), "cluster_id").filter(F.col("n") >= least)
    return grouped.join(masters.select("cluster_id"), "cluster_id", "left_anti")


def ordered_lookup(lists: DataFrame, key: str, member: str, position: str, dimension: DataFrame, dimension_key: str, name: str) -> DataFrame:
    """Per key the names of its members in list order, the first of them and their number. Unknown members are left out."""
    joined = lists.join(dimension.select(F.col(dimension_key).alias(member), F.col(name).alias("_name")), member)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col("_name").alias("n"))))
    named = joined.groupBy(key).agg(F.transform(ordered, lambda x: x["n"]).alias("names"))
    return named.select(key, F.array_join(F.slice("names", 1, 3), ", ").alias("first_names"), F.get("names", F.lit(0)).alias("first_name"), F.size("names").cast("bigint").alias("n_names"))


def nearest(points: DataFrame, places: DataFrame) -> DataFrame:
    """The place (id, lat, lng) nearest each point by squared degrees, the smaller id of equals.

    ``places`` is a dimension of fixed size: it becomes one array, so points are not paired with rows.
    """
    all_places = places.agg(F.collect_list(F.struct("id", "lat", "lng")).alias("places"))
    distance = lambda p: F.pow(p["lat"] - F.col("lat"), 2) + F.pow(p["lng"] - F.col("lng"), 2)
    best = F.array_min(F.transform("places", lambda p: F.struct(distance(p).alias("d"), p["id"].alias("id"))))
    return points.crossJoin(F.broadcast(all_places)).select(*points.columns, best["id"].alias("place_id"))  # one row


def coverage(places: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """Places with their number of sources, 0 included."""
    counted = counts_by(sources, key)
    return places.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def known_names(locations: DataFrame) -> DataFrame:
    """Each location with its parent's name and its path from the top."""
    up = locations.select(F.col("id").alias("parent_id"), F.col("name").alias("parent_name"))
    return locations.join(up, "parent_id", "left").select("id", "name", "type", "parent_id", "parent_name", F.concat_ws(" > ", "parent_name", "name").alias("path"))


def location_query(kind: Column, name: Column, parent: Column) -> Column:
    """The search text for news of a location."""
    return F.when(kind == "nation", F.concat_ws(" ", F.lit("news"), name, parent)).otherwise(F.concat_ws(" ", F.lit("news"), name))


def fallback_bias(values: DataFrame, key: str) -> DataFrame:
    """Mean bias of a key's sources, or a guess from their mean reliability where none is known.

    Both are added as whole millionths, so that the order of addition moves no mean over a boundary.
    """
    whole = lambda c: F.round(F.col(c) * 1_000_000).cast("bigint")
    summed = values.groupBy(key).agg(F.sum(whole("bias")).alias("b"), F.count("bias").alias("n_b"), F.sum(whole("reliability")).alias("r"), F.count("reliability").alias("n_r"))
    # Four digits of the mean, half away from zero.
    size = F.call_function("div", F.abs("b") + F.col("n_b") * 50, F.col("n_b") * 100)
    mean = F.when(F.col("n_b") > 0, F.sign("b") * size / 10_000 + 0.0)
    guess = F.when(F.col("r") > 700_000 * F.col("n_r"), 0.15).when(F.col("r") < 500_000 * F.col("n_r"), -0.15)
    return summed.select(key, F.coalesce(mean, guess, F.lit(0.0)).alias("bias"))


def voices(cards: DataFrame) -> DataFrame:
    """Shares of the three bands per cluster in whole percent; unscored cards are neutral."""
    n = F.count("*")
    share = lambda c: F.floor(F.count_if(c) * 100.0 / n + 0.5).cast("bigint")
    band = bias_band(F.col("bias_signed"))
    return cards.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(*[share(band == b).alias(b) for b in ("official", "neutral", "opposition")], n.alias("n"))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [f.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, f in frames.items()])


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key ``right`` does not have, repeated ones included."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def ranked_within(rows: DataFrame, name: str, keys: list[str], *order: Column) -> DataFrame:
    """Rows with their place within ``keys``."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))


def range_errors(limits: dict[str, tuple], allowed: dict[str, tuple]) -> Column:
    """The names of values out of range (value, least, most; either may be None) or not among those allowed (value, list)."""
    found = []
    for name, (value, least, most) in limits.items():
        checks = ([value < least] if least is not None else []) + ([value > most] if most is not None else [])
        found.append(F.when(reduce(Column.__or__, checks), name))
    found += [F.when(~value.isin(values), name) for name, (value, values) in allowed.items()]
    return F.array_compact(F.array(*found))
