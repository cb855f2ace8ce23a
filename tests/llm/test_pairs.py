from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from edge import documents, odd_texts, prose

from tidewire.llm import minhash, suffix_dedup
from tidewire.llm.minhash import components, drop_near_duplicates, near_duplicates
from tidewire.llm.suffix_dedup import substring_dedup
from tidewire.llm.suffix_sort import suffix_arrays

last = lambda i: (i is None, i or 0)


def near_texts(n=40):
    r = random.Random(8)
    common = prose(99, 12)
    out = []
    for i in range(n):
        words = prose(i, 120).split()
        out.append((10 * i, " ".join(words) + " " + common))
        for c in range(r.randrange(4)):
            copy = list(words)
            for _ in range(c * 2):
                copy[r.randrange(len(copy))] = "changed"
            out.append((10 * i + c + 1, " ".join(copy) + "\n" + common))
    return out


def classes(texts, least=0.8):
    docs = [(t[0], (t[1] or "").split()) for t in texts]
    weigh = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])
    sets = [weigh(w) for _, w in docs]
    n, df = len(docs), Counter(x for s in sets for x in s)
    idf = {x: math.log1p(n / c) / math.log1p(n / minhash.LEAST_COMMON) for x, c in df.items()}
    total = [sum(k * idf[x] for x, k in s.items()) for s in sets]
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(n), 2):
        both = sum(min(k, sets[b][x]) * idf[x] for x, k in sets[a].items() if x in sets[b])
        if docs[a][1] == docs[b][1] or (both and both / (total[a] + total[b] - both) >= least):
            root[find(a)] = find(b)
    members = {}
    for i in range(n):
        members.setdefault(find(i), []).append(docs[i][0])
    best = {k: min(v, key=last) for k, v in members.items()}
    return sorted(((docs[i][0], best[find(i)], len(members[find(i)])) for i in range(n)), key=repr)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_classes_equal_all_pairs(spark, monkeypatch, small_blocks):
    if small_blocks:  # every bucket in blocks
        whole = minhash.verified_links
        monkeypatch.setattr(minhash, "verified_links", lambda *a: whole(*a, most_features=300, most_nodes=2))
    texts = odd_texts() + [(1000 + i, t) for i, t in near_texts()]
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in near_duplicates(documents(spark, texts)).collect()]
    assert sorted(got, key=repr) == classes(texts)


def test_near_filter_keeps_one_of_each(spark):
    texts = near_texts(10)
    docs = documents(spark, texts)
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, c, _ in classes(texts)})


def test_near_filter_tells_rows_of_one_number_apart(spark):
    a, b = prose(1, 50), prose(2, 50)
    out = drop_near_duplicates(documents(spark, [(3, a), (5, a + " x"), (5, b), (None, a), (None, b)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in out) == [(3, a), (5, b)]


def test_near_filter_keeps_one_of_repeated_rows(spark):
    a, b = prose(1, 50), prose(2, 50)
    docs = documents(spark, [(1, a), (1, a), (1, a + " "), (2, a), (3, b), (3, b), (None, None), (None, None)]).selectExpr("*", "7 AS gone_id", "8 AS key", "9 AS hash", "1 AS one_stays")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], (r["text"] or "").strip()) for r in out.collect()), key=repr) == [(1, a), (3, b), (None, "")]
    assert near_duplicates(docs).filter("kept").count() == 3


def test_near_of_nothing(spark):
    assert drop_near_duplicates(documents(spark, [(1, "x")]).filter("false")).collect() == []
    assert near_duplicates(documents(spark, [(1, "x")]).filter("false")).collect() == []
    assert [tuple(r) for r in near_duplicates(documents(spark, [(4, None), (3, " ")])).orderBy("doc_id").collect()] == [(3, 3, 2, True), (4, 3, 2, False)]


def test_every_shingle_has_its_own_weight(spark):
    # Three documents share 56 shingles and have six of their own each: 0.82 with equal weights, 0.74 by rarity.
    shared, own = prose(31, 60), [prose(32 + i, 6) for i in range(3)]
    texts = [(i, f"{shared} {o}") for i, o in enumerate(own)] + [(10 + i, prose(50 + i, 60)) for i in range(6)]
    got = [(r["doc_id"], r["class_id"], r["class_size"]) for r in near_duplicates(documents(spark, texts)).collect()]
    assert sorted(got, key=repr) == classes(texts)
    assert sorted(got) == [(i, i, 1) for i, _ in texts]


def test_sampler_estimates_weighted_similarity():
    r = np.random.default_rng(1)
    h = r.integers(0, 1 << 62, 300, "uint64")
    w = r.uniform(0.2, 3, 300)
    a, b = np.arange(0, 240), np.arange(60, 300)
    s = minhash.Sampler(2000)
    x = s(np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]), np.array([0, 240]))
    want = w[60:240].sum() / w.sum()
    assert abs((x[:, 0] == x[:, 1]).mean() - want) < 0.05


def test_components(spark):
    r = random.Random(4)
    links = [(bytes([i]), bytes([i + 1])) for i in range(100) if i % 10] + [(bytes([200]), bytes([i])) for i in range(201, 240)]
    r.shuffle(links)
    got = {bytes(x["node"]): bytes(x["root"]) for x in components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert all(got[bytes([i])] == bytes([10 * ((i - 1) // 10) + 1]) for i in range(1, 101) if (i - 1) // 10 < 10 and bytes([i]) in got)
    assert {got[bytes([i])] for i in range(200, 240)} == {bytes([200])}


def removed(texts, width=50):
    docs = sorted({(t[0], (t[1] or "").encode()) for t in texts}, key=lambda d: (last(d[0]), d[1]))
    first = {}
    for doc_id, b in docs:
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], last(doc_id))
    out = {}
    for doc_id, b in docs:
        cover = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < last(doc_id):
                cover[i : i + width] = b"\1" * width
        kept = bytes(c for c, g in zip(b, cover, strict=True) if not g)
        out[doc_id, b] = (len(b), len(b) - len(kept), sum(1 for i, g in enumerate(cover) if g and not (i and cover[i - 1])), hashlib.sha256(kept).hexdigest(), kept)
    return out


def shared_passages():
    passage, r = prose(5, 40), random.Random(6)
    out = [(30 + i, prose(100 + i, 20) + " " + passage[i : 200 + 3 * i] + " " + prose(200 + i, 20)) for i in range(40)]
    out += [(80, "a" * 300), (81, "a" * 120 + "b" + "a" * 60), (82, "ab" * 100), (83, "ñ" * 60), (84, "x" + "ñ" * 70)]
    return out + [(90 + i, "".join(r.choice("ab") for _ in range(30)) * 6) for i in range(10)]


@pytest.mark.parametrize(("lane", "crowd"), [(4096, 20_000), (200, 20_000), (4096, 3)])
def test_substrings_equal_brute_force(spark, monkeypatch, lane, crowd):
    monkeypatch.setattr(suffix_dedup, "LANE", lane)
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    texts = odd_texts() + shared_passages()
    want = removed(texts)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in substring_dedup(documents(spark, texts).repartition(3)).collect()]
    clean = [(None if i is None or i != i else int(i), *rest) for i, *rest in got]
    assert sorted(clean, key=repr) == sorted(((t[0], *want[t[0], (t[1] or "").encode()]) for t in texts), key=repr)


def test_anchors_in_steps():
    r = np.random.default_rng(2)
    data, bounds = r.integers(97, 100, 3000).astype("uint8"), np.array([0, 700, 730, 730, 2990, 3000])
    whole = suffix_dedup.anchors(data, bounds, 50, 24)
    covered = {(t, f + k): h for h, t, f, n, _ in zip(*whole, strict=True) for k in range(n)}
    assert set(covered) == {(t, i) for t in range(5) for i in range(bounds[t + 1] - bounds[t] - 49)}
    for step in (1, 64, 999):
        parts = suffix_dedup.anchors(data, bounds, 50, 24, step)
        assert {(t, f + k): h for h, t, f, n, _ in zip(*parts, strict=True) for k in range(n)} == covered


def test_leads_do_not_depend_on_the_place():
    r = np.random.default_rng(3)
    noise, rule = r.integers(97, 123, 2 << 20).astype("uint8"), np.frombuffer(b"=-" * 38, "uint8")

    def leads(before: int) -> list[int]:
        data = np.concatenate([noise[:before], rule, noise[before : before + 100]])
        runs = zip(*suffix_dedup.anchors(data, np.array([0, before, before + 76, len(data)]), 50, 24)[1:], strict=True)
        return [at - f - k for t, f, n, at in runs if t == 1 for k in range(n)]

    want = leads(100)
    assert len(want) == 27
    for end in (1 << 20, (1 << 20) - 50, 2 << 20):
        for shift in (75, 50, 38, 25, 1):
            assert leads(end - shift) == want


def test_substrings_of_nothing(spark):
    assert substring_dedup(documents(spark, [(1, "x")]).filter("false")).collect() == []


def test_suffix_arrays():
    r = random.Random(3)
    for _ in range(100):
        lanes, text = [], []
        for _ in range(r.randrange(1, 20)):
            lanes.append(len(text))
            text += [r.randrange(1, r.choice([2, 3, 20])) for _ in range(r.randrange(60))] + [0]
        got = suffix_arrays(np.array(text), np.array(lanes))
        for a, b in itertools.pairwise([*lanes, len(text)]):
            assert (got[a:b] - a).tolist() == sorted(range(b - a), key=lambda i: text[a:b][i:])
