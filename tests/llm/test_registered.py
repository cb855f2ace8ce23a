"""The registered queries that have no SQL, called as they are, against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import tiktoken
from test_pairs import classes, removed
from test_tokens import JSON, PATTERN, RANKS, check_packing
from tokenizers import Tokenizer

from tidewire.llm.bpe import load_ranks
from tidewire.llm.queries import QUERIES


def texts_of(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def test_packing(spark, sf):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in texts_of(spark, sf)]
    bins = check_packing(QUERIES["op1_pack"](spark, sf).collect(), ids, 2048)
    assert bins <= -(-sum(len(x) for _, x in ids) // 2048) + 1


def test_encoding(spark, sf):
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, x in texts_of(spark, sf):
        ids = library.encode_ordinary(x or "")
        want.append((i, len(ids), sha(np.asarray(ids, "<u4").tobytes()), sha((x or "").encode())))
    assert sorted(map(tuple, QUERIES["op3_bpe"](spark, sf).collect())) == sorted(want)


def test_near_duplicates(spark, sf):
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in QUERIES["op6_minhash"](spark, sf).collect()]
    assert sorted(got, key=repr) == classes(texts_of(spark, sf))


def test_token_counts(spark, sf):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    got, chars = Counter(), Counter()
    for r in QUERIES["op8_tokens"](spark, sf).collect():
        got[r["doc_id"]] += r["n_tokens"]
        chars[r["doc_id"]] += r["length"]
    for i, x in texts_of(spark, sf):
        assert got[i] == len(t.encode(x or "", add_special_tokens=False).ids) and chars[i] == len(x or "")


def test_substrings(spark, sf):
    want = {i: v for (i, _), v in removed(texts_of(spark, sf)).items()}
    rows = QUERIES["op9_suffix"](spark, sf).collect()
    assert len(rows) == len(want)
    assert all((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]][:4] for r in rows)
