"""Exact duplicates by a tree merge of digest runs.

Every input partition is a run of digests. A round merges the runs whose numbers agree
but for their lowest bits, so ``fan_in`` runs meet at a time (a binomial tree with
log2(fan_in) levels a round), and each merge keeps one verified candidate per digest. What a
round leaves is written as sorted runs, so a lost executor costs no earlier round. A digest
that fills a third of the input arrives at each round as one row per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import SPACE_CHARS, cut, join_small, release, text_or_empty


def normalised(text: Column) -> Column:
    return F.translate(text, SPACE_CHARS, "")


def digest_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, proof, n_chars, run, row): what the merge needs of a document, not its text."""
    text = text_or_empty()
    norm = docs.select("doc_id", F.length(text).cast("long").alias("n_chars"), normalised(text).alias("norm"))
    return norm.select(
        "doc_id",
        "n_chars",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64(F.length("norm"), "norm").alias("proof"),
        F.spark_partition_id().alias("run"),
        F.monotonically_increasing_id().alias("row"),
    )


def _merge(runs: DataFrame) -> DataFrame:
    """One row per run and digest, in their order: the smallest candidate and the number of rows behind it."""
    merged = runs.groupBy("run", "digest", "proof").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return cut(merged.sortWithinPartitions("run", "digest", "proof"))


def tree_merge(runs: DataFrame, fan_in: int = 8) -> DataFrame:
    """(digest, proof, best, n) over all runs. ``fan_in`` is a power of two."""
    bits = fan_in.bit_length() - 1
    if fan_in != 1 << bits or bits < 1:
        raise ValueError("fan_in must be a power of two, 2 or more")
    # Most characters first, then the smallest identifier, a null identifier last; of repeated rows the first.
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    merged = _merge(runs.select("run", "digest", "proof", best.alias("best"), F.lit(1).cast("long").alias("n")))
    last = runs.agg(F.max("run")).first()[0] or 0
    while last:
        last >>= bits
        before, merged = merged, _merge(merged.withColumn("run", F.shiftright("run", bits)))
        release(before)
    return merged.drop("run")


def exact_dedup(docs: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per row of ``docs`` with the row of its group that stays.

    Texts are equal when identical without their white space ([\\x20\\x09-\\x0D]). Of equal
    texts the one with the most code points stays, then the smallest doc_id.

    Null text counts as empty, and empty texts equal each other. A null doc_id loses to any
    other. Rows that repeat a doc_id count in group_size one by one, and one of a group's rows
    is kept, however many have its keep_id. An empty table gives no rows. Other columns are
    ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    runs = cut(digest_runs(docs))
    # Rows of digests of their own meet nothing; while the others' digests are few, no row is shuffled for them.
    copies = cut(tree_merge(runs, fan_in).filter("n > 1"))
    joined = join_small(runs, copies, ["digest", "proof"], "left", row_bytes=160)
    return joined.select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
