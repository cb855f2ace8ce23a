from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from edge import documents, odd_texts, prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm.bpe import Codec, decode, encode, load_ranks, round_trip
from tidewire.llm.chunks import split
from tidewire.llm.packing import fullest, pack, plan
from tidewire.llm.token_counts import section_tokens

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def spaced_texts(n: int) -> list[str]:
    r = random.Random(5)
    bits = ["a", "b", "aa", " ", "e", "é", "\n", "in", "the", "  ", "1", ".", "\t", "日", " ", "\x1c", "\x85", "’s", "'ll", "<|endoftext|>"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(40))) for _ in range(n)]


def test_chunks_encode_alone(library):
    for t in spaced_texts(500):
        assert [i for c in split(t, regex.compile(PATTERN)) for i in library.encode_ordinary(c)] == library.encode_ordinary(t)


def test_merge_replay_equals_the_library(library):
    c = Codec(RANKS, PATTERN)
    texts = spaced_texts(500) + ["a" * 3000, "ab" * 500, prose(4, 300)]
    ids, bounds = c.table.encoded(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(t), t
    assert c.decode(ids, bounds) == [t.encode() for t in texts]


def test_full_tables_start_afresh(library):
    c = Codec(RANKS, PATTERN, 50)
    texts = [prose(i, 30) for i in range(20)]
    for _ in range(2):
        for i in range(0, 20, 5):
            ids, bounds = c.table.encoded(pa.array(texts[i : i + 5]))
            for k in range(5):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == library.encode_ordinary(texts[i + k])


def test_round_trip(spark, library):
    texts = odd_texts()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for t in texts:
        ids = library.encode_ordinary(t[1] or "")
        want.append((t[0], len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((t[1] or "").encode())))
    got = [(None if r[0] is None or r[0] != r[0] else int(r[0]), *tuple(r)[1:]) for r in round_trip(documents(spark, texts), RANKS, PATTERN).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    encoded = encode(documents(spark, texts), RANKS, PATTERN)
    assert sorted(bytes(r["bytes"]) for r in decode(encoded, RANKS, PATTERN).collect()) == sorted((t[1] or "").encode() for t in texts)


def check_packing(rows, ids, capacity):
    pieces = sorted(((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows))
    want = []
    for doc_id, own in ids:
        start, length, piece = 0, len(own) if len(own) <= capacity else len(own) % capacity or capacity, 0
        while start < len(own):
            want.append((doc_id is None, doc_id or 0, piece, start, length, zlib.crc32(np.asarray(own[start : start + length], "<u4").tobytes())))
            piece, start, length = piece + 1, start + length, capacity
    assert pieces == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, tokenizer):
    texts = odd_texts() + [(100 + i, prose(i, 5 + i % 9)) for i in range(200)]
    ids = [(t[0], [*tokenizer.encode(t[1] or "", add_special_tokens=False).ids, 0]) for t in texts]
    for capacity in (2048, 64):
        rows = pack(documents(spark, texts).repartition(5), JSON, capacity).collect()
        bins = check_packing(rows, ids, capacity)
        assert bins <= -(-sum(len(i) for _, i in ids) // capacity) + 2
    assert pack(documents(spark, texts).filter("false"), JSON).collect() == []


def test_fullest_is_optimal():
    r = random.Random(9)
    for _ in range(300):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(r.randrange(1, 6))}
        room = r.randrange(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = fullest(counts, room)
        assert all(k <= counts[n] for n, k in used.items())
        assert sum(n * k for n, k in used.items()) == max(s for s in sums if s <= room)


def test_plan_places_every_rank():
    r = random.Random(3)
    histogram = {n: r.randrange(1, 500) for n in range(1, 64)}
    seen = {n: 0 for n in histogram}
    for n, first, beyond, times, _, _ in plan(histogram, 64):
        assert first == seen[n] and (beyond - first) % times == 0
        seen[n] = beyond
    assert seen == histogram


def sections(spans, starts, length):
    ends = [*starts[1:], length]
    n, crossing = [0] * len(starts), [0] * len(starts)
    for a, b in spans:
        shares = [max(0, min(b, e) - max(a, s)) for s, e in zip(starts, ends, strict=True)]
        own = shares.index(max(shares)) if max(shares) else max(i for i, s in enumerate(starts) if s <= a)
        n[own] += 1
        crossing[own] += sum(x > 0 for x in shares) > 1
    return n, crossing


@pytest.mark.parametrize("cut", [None, [3, 7, 7, 5, 60, 10_000_000]])
def test_section_tokens(spark, tokenizer, cut):
    texts = [(i, t[1]) for i, t in enumerate(odd_texts())]
    docs = documents(spark, texts)
    if cut:
        docs = docs.withColumn("cuts", F.when(F.col("doc_id") % 5 == 4, F.lit(None)).otherwise(F.array(*map(F.lit, cut))))
    got = {}
    for r in section_tokens(docs, JSON, "cuts" if cut else None).orderBy("doc_id", "section").collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["n_tokens"], r["n_crossing"]))
    for i, text in texts:
        t = text or ""
        if cut is None:
            parts = t.split("\n")
            starts = [sum(len(p) + 1 for p in parts[:k]) for k in range(len(parts))]
            starts = starts[:-1] if len(starts) > 1 and starts[-1] == len(t) else starts
        else:
            starts = [0] if i % 5 == 4 else [0, *(s for s in (3, 7, 60) if s < len(t))]
        spans = tokenizer.encode(t, add_special_tokens=False).offsets
        n, crossing = sections(spans, starts, len(t))
        lengths = [b - a for a, b in zip(starts, [*starts[1:], len(t)], strict=True)]
        assert got[i] == list(zip(starts, lengths, n, crossing, strict=True)), i
