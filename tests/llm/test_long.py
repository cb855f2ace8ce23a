"""Texts of megabytes, and empty tables, for every operator and stage."""

from __future__ import annotations

import hashlib

import corpus_pipeline
import pytest
from edge import documents, prose
from test_native import counts
from test_tokens import JSON, PATTERN, RANKS

from tidewire.llm.bpe import round_trip
from tidewire.llm.line_dedup import line_dedup
from tidewire.llm.packing import pack
from tidewire.llm.quality import quality_rules
from tidewire.llm.suffix_dedup import substring_dedup
from tidewire.llm.token_counts import section_tokens

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


@pytest.fixture(scope="module")
def long_texts():
    one = "\n".join(prose(s, 40) for s in range(12_000))
    assert len(one) > 2_500_000
    return [(1, one), (2, "head\n" + one), (3, "short")]


def test_quality_of_a_long_text(spark, long_texts):
    got = {r["doc_id"]: tuple(r)[1:7] for r in quality_rules(documents(spark, long_texts)).collect()}
    assert got == {i: counts(t) for i, t in long_texts}


def test_lines_of_a_long_text(spark, long_texts):
    got = {r["doc_id"]: (r["n_removed"], r["text_sha256"]) for r in line_dedup(documents(spark, long_texts)).collect()}
    assert got == {1: (0, sha(long_texts[0][1])), 2: (12_000, sha("head")), 3: (0, sha("short"))}


def test_bytes_of_a_long_text(spark, long_texts):
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substring_dedup(documents(spark, long_texts)).collect()}
    n = len(long_texts[0][1])
    assert got[1] == (0, 0) and got[3] == (0, 0) and got[2] == (n, 1)


def test_tokens_of_a_long_text(spark, long_texts):
    docs = documents(spark, long_texts)
    assert {r["doc_id"]: r["decoded_sha256"] for r in round_trip(docs, RANKS, PATTERN).collect()} == {i: sha(t) for i, t in long_texts}
    assert sum(r["length"] for r in section_tokens(docs, JSON).collect()) == sum(len(t) for _, t in long_texts)


def test_operators_of_nothing(spark):
    docs = documents(spark, [(1, "x")]).filter("false")
    for out in (round_trip(docs, RANKS, PATTERN), section_tokens(docs, JSON), pack(docs, JSON)):
        assert out.collect() == []


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_nothing(spark, name):
    docs = documents(spark, [(1, "x")]).filter("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").collect() == []


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, [(1, "x")]).select("doc_id", "text", "lang", "source", "n_chars").filter("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
