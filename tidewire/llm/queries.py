"""The corpus operators bound to the tables, with production parameters. Each reads its whole table."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.bpe import round_trip
from tidewire.llm.common import table, text_or_empty
from tidewire.llm.exact_dedup import exact_dedup
from tidewire.llm.line_dedup import line_dedup
from tidewire.llm.minhash import near_duplicates
from tidewire.llm.packing import pack
from tidewire.llm.periodic import periodic_runs
from tidewire.llm.quality import quality_rules
from tidewire.llm.secrets import secret_scan
from tidewire.llm.simhash import simhash_classes
from tidewire.llm.spelling import spelling_variants
from tidewire.llm.suffix_dedup import substring_dedup
from tidewire.llm.token_counts import section_tokens
from tidewire.llm.warc import archive_round_trip


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"), least=0)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's title (60 characters), summary (to 280) and body, as card views cut them."""
    fields = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"), F.array(F.lit(60), F.lit(280)).alias("fields"))
    return section_tokens(fields, public_tokenizers.path("byte_bpe_50k.json"), "fields")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), 50).drop("kept")


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).drop("text")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


def folded(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents (by a hash of doc_id; none without one) repeat a piece of theirs up to the end."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), words_of=folded).drop("collapsed")


def misspelt(doc_id: int | None, word: str) -> str:
    """One in 199 words of a document loses a character, by a hash of both; a null doc_id counts as no digits."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 199 else word[:at] + word[at + 1 :]


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"), altered=misspelt)


QUERIES = {
    "op1_pack": op1_pack,
    "op2_quality": op2_quality,
    "op3_bpe": op3_bpe,
    "op4_secrets": op4_secrets,
    "op5_warc": op5_warc,
    "op6_minhash": op6_minhash,
    "op7_exact": op7_exact,
    "op8_tokens": op8_tokens,
    "op9_suffix": op9_suffix,
    "op10_lines": op10_lines,
    "op11_simhash": op11_simhash,
    "op12_periodic": op12_periodic,
    "op13_spelling": op13_spelling,
}
