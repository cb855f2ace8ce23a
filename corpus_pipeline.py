"""Corpus preparation from documents to packed sequences, stage by stage.

An empty table gives an empty one at every stage. Columns beside those of documents come
through all stages but the last, whatever their names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import shared_dir, table
from tidewire.llm.line_dedup import drop_repeated_lines
from tidewire.llm.minhash import drop_near_duplicates
from tidewire.llm.packing import pack
from tidewire.llm.quality import filter_quality
from tidewire.llm.secrets import redact


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them null and empty texts; repeated rows share a verdict."""
    return filter_quality(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines are cut out; documents of which nothing is left go. Null texts and repeated rows stay."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest doc_id stays, one row of it. Null counts as empty."""
    return drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by the names of their kinds. Null texts and repeated rows come through as they are."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 2048 tokens; a null text is one piece, the end alone."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("secrets", secrets), ("packing", packing)]

#: The weighted MinHash stage and the tokenizer have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
