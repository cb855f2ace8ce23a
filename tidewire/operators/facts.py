"""Facts and perspectives of clusters of articles, from their sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.labels import bias_band
from tidewire.functions.text import sentence_key, sentences


def sentence_rows(articles: DataFrame) -> DataFrame:
    """(cluster_id, id, bias, position, sentence, key) of articles with cluster_id, id, bias, text."""
    # Keys are made before sentences are rows: a filter on a column that is made of another would make it twice.
    keyed = F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("sentence"), sentence_key(s).alias("key")))
    rows = articles.select("cluster_id", "id", "bias", F.posexplode(keyed).alias("position", "found"))
    return rows.select("cluster_id", "id", "bias", "position", "found.sentence", "found.key").filter("key != ''")


def counted(rows: DataFrame, verified_at: int = 3) -> DataFrame:
    """Every sentence of each cluster: how many articles' sentences share the key, with what bias."""
    # The key comes first, as rows are sorted by it: its first letters tell rows apart, those of a cluster do not.
    grouped = rows.groupBy("key", "cluster_id").agg(
        F.count("*").alias("frequency"),
        F.min_by("sentence", F.struct("id", "position")).alias("sentence"),
        F.round(F.min("bias"), 4).alias("bias_min"),
        F.round(F.max("bias"), 4).alias("bias_max"),
        F.round(F.avg("bias"), 4).alias("bias_avg"),
    )
    status = F.when(F.col("frequency") >= verified_at, "verified").otherwise("disputed").alias("status")
    return grouped.select("cluster_id", "key", "frequency", "sentence", "bias_min", "bias_max", "bias_avg", status)


def facts(rows: DataFrame, verified_at: int = 3, most: int = 20) -> DataFrame:
    """The most frequent sentences of each cluster, ranked."""
    ranked = counted(rows, verified_at).withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("frequency"), "key")).cast("bigint"))
    return ranked.filter(F.col("rank") <= most)


# Units of money that may stand behind an amount.
MONEY_UNITS = ("millones", "mil", "billones", "M", "K")
#: Capital letters and small ones that names are written with.
CAPITAL, SMALL = "[A-ZÁÉÍÓÚÑ]", "[a-záéíóúñ]"
#: Where a word begins and ends, letters of any alphabet being parts of words; what \b means differs between versions of Java.
BEGINS, ENDS = r"(?<![\p{L}\p{M}\p{Nd}_])", r"(?![\p{L}\p{M}\p{Nd}_])"


def entity_kinds(units: tuple[str, ...] = MONEY_UNITS, of: str = "de", before_places: tuple[str, ...] = ("in", "en", "of", "de")) -> dict[str, tuple[str, int]]:
    """What is looked for in sentences, and how many of each kind are kept.

    Letters of dates and units may be capital or small; of units the longest counts, as a
    whole word. A date is of numbers or has the month as a word between two ``of``. A number is
    grouped by threes or plain. A place is a name behind one of the words ``before_places``,
    as a capital alone also begins every sentence; a name has two to four words.
    """
    unit = "|".join(sorted(units, key=lambda u: (-len(u), u)))
    name = f"{CAPITAL}{SMALL}+"
    return {
        "date": (rf"(?iu){BEGINS}(?:[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}|[0-9]{{1,2}}\s+{of}\s+[a-záéíóúñ]+\s+{of}\s+[0-9]{{4}}){ENDS}", 10),
        "money": (rf"(?iu)\$\s*[0-9][0-9.,]*(?:\s*(?:{unit}){ENDS})?", 10),
        "percent": (rf"{BEGINS}[0-9]+[%％]", 10),
        "number": (rf"{BEGINS}(?:[0-9]{{1,3}}(?:[.,][0-9]{{3}})+(?:[.,][0-9]+)?|[0-9]+(?:[.,][0-9]+)?){ENDS}", 10),
        "name": (rf"{BEGINS}{name}(?:\s+{name}){{1,3}}", 15),
        "place": (rf"{BEGINS}(?:{'|'.join(before_places)}) {name}", 15),
    }


ENTITIES = entity_kinds()


def entities_by_kind(text: Column, kinds: dict[str, tuple[str, int]] | None = None) -> dict[str, Column]:
    """Per kind the different whole matches, sorted, as many as its entry says."""
    return {k: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0)))), 1, most) for k, (p, most) in (kinds or ENTITIES).items()}


def entities(text: Column, patterns: dict[str, str], most: int = 10) -> Column:
    """Different whole matches of all patterns, sorted."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns.values()]))
    return F.slice(F.array_sort(F.array_distinct(found)), 1, most)


def perspectives(articles: DataFrame, edge: float = 0.3, most: int = 3) -> DataFrame:
    """Per cluster and band: articles, mean bias and the first sentences of its first articles."""
    first = articles.withColumn("band", bias_band(F.col("bias"), edge)).withColumn("lead", F.get(sentences(F.col("text")), F.lit(0)))
    # The heap of the first few is kept by rank; the rest of a band is only counted.
    w = Window.partitionBy("cluster_id", "band").orderBy("id")
    led = first.filter("lead is not null").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    leads = led.groupBy("cluster_id", "band").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "lead"))), lambda x: x["lead"]), " / ").alias("leads"))
    counted = first.groupBy("cluster_id", "band").agg(F.count("*").alias("n"), F.round(F.avg("bias"), 4).alias("mean_bias"))
    return counted.join(leads, ["cluster_id", "band"], "left").withColumn("leads", F.coalesce("leads", F.lit("")))


#: Words that a headline shouts with.
SHOUTS = r"(?i)^\s*(?:breaking|urgent|exclusive|alert)\s*[-:]\s*"


def calm_title(title: Column, least: int = 5, default: str = "Synthesis") -> Column:
    """A title without shouts and tags, or the default if too little is left."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), SHOUTS, ""), "<[^>]+>", ""))
    return F.when(F.length(bare) < least, F.lit(default)).otherwise(bare)


def fallback(articles: DataFrame, found: DataFrame, edge: float = 0.2, most: int = 5, spare: int = 3) -> DataFrame:
    """Per cluster a base article and a summary from its verified facts, of articles (cluster_id, id, bias, summary).

    The base is the first article with low bias in order of bias, else the middle one; only
    clusters without a neutral article are put in order for that. Where no fact is verified
    the summary is made of those of the first ``spare`` neutral articles, else it is the base's.
    """
    neutral = F.when(F.abs("bias") < edge, F.struct("bias", "id"))
    per = articles.groupBy("cluster_id").agg(F.min(neutral)["id"].alias("neutral_id"), F.count("*").alias("n"))
    lone = articles.join(per.filter("neutral_id is null").select("cluster_id", "n"), "cluster_id")
    placed = lone.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy("bias", "id")))
    middle = placed.filter(F.col("place") == F.floor(F.col("n") / 2) + 1).select("cluster_id", F.col("id").alias("middle_id"))
    text = found.filter((F.col("rank") <= most) & (F.col("status") == "verified")).groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sentence"))), lambda x: x["sentence"]), ". ").alias("summary"))
    joined = per.join(middle, "cluster_id", "left").join(text, "cluster_id", "left").withColumn("base_id", F.coalesce("neutral_id", "middle_id"))
    told = articles.select("cluster_id", F.col("id").alias("base_id"), "bias", F.coalesce("summary", F.lit("")).alias("told"))
    calm = told.filter(F.abs("bias") < edge).withColumn("n", F.row_number().over(Window.partitionBy("cluster_id").orderBy("bias", "base_id"))).filter((F.col("n") <= spare) & (F.col("told") != ""))
    spared = calm.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "told"))), lambda x: x["told"]), " | ").alias("spared"))
    filled = joined.join(spared, "cluster_id", "left").join(told.drop("bias"), ["cluster_id", "base_id"], "left")
    summary = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.col("summary"), F.lit("")), "spared", "told", F.lit("")), "<[^>]+>", ""))
    return filled.select("cluster_id", "base_id", F.col("n"), F.left(summary, F.lit(1000)).alias("summary"))


def batch(sizes: DataFrame, counted_facts: DataFrame, mastered: DataFrame, limit: int = 100) -> DataFrame:
    """(cluster_id, n, outcome) of the largest ``limit`` clusters (cluster_id, n) that have no master.

    A cluster of fewer than two articles is skipped, and one without a verified fact fails.
    """
    due = sizes.join(mastered.select("cluster_id"), "cluster_id", "left_anti").orderBy(F.desc("n"), "cluster_id").limit(limit)
    verified = counted_facts.filter("status = 'verified'").groupBy("cluster_id").agg(F.count("*").alias("verified"))
    outcome = F.when(F.col("n") < 2, "skipped").when(F.coalesce("verified", F.lit(0)) == 0, "failed").otherwise("success")
    return due.join(verified, "cluster_id", "left").select("cluster_id", "n", outcome.alias("outcome"))
