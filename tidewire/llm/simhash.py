"""SimHash near duplicates by one-wildcard variants of half fingerprints.

Two fingerprints of 64 bits that differ in at most two differ in at most one bit of one of
their halves. Each half is indexed under itself and under its 32 variants with one bit left
open, the halves with a 0 there against those with a 1; an equality join of the two sides
meets every such pair, and the number of differing bits is then counted.

Half fingerprints that more than ``crowd`` fingerprints share do not meet in pairs. They, and
what would meet them, are gathered under every fingerprint at a distance of at most one:
fingerprints gathered under the same one are within two bits of each other, and any two
within two bits have such a one in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.chunks import column, small_batches
from tidewire.llm.common import cut, join_hot, join_small, release, text_or_empty
from tidewire.llm.minhash import components

HALF, NO_WILDCARD = 32, 32


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes, as a signed number."""
    ones = np.zeros(64, "int64")
    for lo in range(0, len(hashes), block):
        ones += np.unpackbits(hashes[lo : lo + block].view("uint8").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """SimHash of a text's shingles of ``width`` words, A-Z in lower case; zero without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return majority(np.fromiter((digest(g, seed) for g in grams), "<u8"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in small_batches(batches):
            found = [fingerprint(t, width) for t in column(part, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


#: The two halves of the number fp, as SQL.
HALVES = (f"(fp & {(1 << HALF) - 1}L)", f"shiftrightunsigned(fp, {HALF})")


def key_of(side: int, position: str, value: str) -> str:
    """SQL of one number for a half, its open position (NO_WILDCARD if there is none) and its other bits."""
    opened = f"CASE WHEN {position} = {NO_WILDCARD} THEN {value} ELSE {value} & ~shiftleft(1L, {position}) END"
    return f"({side << 38}L | shiftleft(bigint({position}), {HALF}) | ({opened}))"


def variants(nodes: DataFrame, bit: int) -> DataFrame:
    """(key, fp): each half as it is, and its variants that leave open one position where it has ``bit``."""
    positions = lambda value: f"filter(sequence(0, {NO_WILDCARD}), p -> p = {NO_WILDCARD} OR (shiftright({value}, p) & 1L) = {bit})"
    keys = [f"transform({positions(value)}, p -> {key_of(side, 'p', value)})" for side, value in enumerate(HALVES)]
    return nodes.select(F.explode(F.expr(f"concat({', '.join(keys)})")).alias("key"), "fp")


def crowded_keys(nodes: DataFrame, crowd: int) -> DataFrame:
    """The keys under which the halves stand that over ``crowd`` fingerprints share."""
    halves = nodes.select(F.posexplode(F.expr(f"array({', '.join(HALVES)})")).alias("side", "value"))
    large = halves.groupBy("side", "value").agg(F.count("*").alias("n")).filter(F.col("n") > crowd)
    opened = large.select("side", "value", F.explode(F.sequence(F.lit(0), F.lit(NO_WILDCARD))).alias("p"))
    return opened.select(F.expr(f"CASE side WHEN 0 THEN {key_of(0, 'p', 'value')} ELSE {key_of(1, 'p', 'value')} END").alias("key")).distinct()


def close_links(nodes: DataFrame, crowd: int) -> DataFrame:
    """(a, b): links that connect ``nodes`` (distinct fp) as all pairs within two bits do."""
    zeros, ones = variants(nodes, 0), variants(nodes, 1)
    crowded = cut(crowded_keys(nodes, crowd))
    apart = None
    if not crowded.isEmpty():
        everything = zeros.union(ones)
        gathered = cut(join_small(everything, crowded, "key", "left_semi", row_bytes=64).select("fp").distinct())
        around = gathered.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), p -> fp ^ shiftleft(1L, p)))")).alias("middle"))
        least = around.groupBy("middle").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a < z").select("middle", "a")
        apart = around.join(least.hint("merge"), "middle").filter("a < fp").select("a", F.col("fp").alias("b"))
        zeros, ones = (join_small(x, crowded, "key", "left_anti", row_bytes=64) for x in (zeros, ones))
    a, b = zeros.select("key", F.col("fp").alias("a")), ones.select("key", F.col("fp").alias("b"))
    # Equal halves have both sides under one key; halves that differ at the open position are on one side each.
    # Spark takes exploded rows for as large as the file they come from and would broadcast 33 times that.
    links = a.join(b.hint("merge"), "key").filter(f"((shiftright(key, {HALF}) & 63L) != {NO_WILDCARD} OR a < b) AND bit_count(a ^ b) <= 2").select("a", "b")
    return links if apart is None else links.union(apart)


def simhash_classes(docs: DataFrame, width: int = 3, crowd: int = 64) -> DataFrame:
    """doc_id, fingerprint, component_id: one row per row of ``docs``.

    Fingerprints link when at most two bits differ; component_id is the smallest doc_id that
    links reach, the document's own included. A ``crowd`` only changes how links are found.

    Words are what white space ([\\x20\\x09-\\x0D]) separates. Null text counts as empty; texts
    without words have the fingerprint zero and link like any other, texts of fewer than
    ``width`` words have one shingle. A null doc_id is never the smallest unless all of a
    component are null. Repeated rows come through one by one. An empty table gives no rows.
    Other columns are ignored.
    """
    found = cut(fingerprints(docs, width))
    nodes = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = cut(components(close_links(nodes.select("fp"), crowd)))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"), F.col("root").isNotNull().alias("linked"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # A fingerprint of one row without links is its own component.
    shared = cut(rooted.filter("linked or n > 1").join(smallest, "root").select("fp", "n", "component_id"))
    joined = join_hot(found, shared, "fp", row_bytes=64)
    release(nodes, roots)
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
