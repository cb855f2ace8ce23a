from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from edge import documents, odd_texts, prose
from test_registered import texts_of

from tidewire.llm.periodic import numbered, periodic_runs, runs_of
from tidewire.llm.queries import QUERIES

sha = lambda t: hashlib.sha256(t.encode()).hexdigest()


def plain_runs(words, least=24, times=3):
    """{(start, length): smallest period}: every stretch in which words q apart agree, for every q."""
    found = {}
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([ids[w] for w in words], "int64")
    for q in range(1, len(words) // times + 1):
        same = np.flatnonzero(np.diff(np.concatenate(([0], (x[:-q] == x[q:]).view("int8"), [0]))))
        for s, e in same.reshape(-1, 2).tolist():
            if e - s + q >= max(least, times * q):
                found.setdefault((s, e - s + q), q)
    return found


def plain(doc_id, words):
    runs = sorted((s, n, q) for (s, n), q in plain_runs(words).items())
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeating(seed):
    """Words of few kinds with repeated blocks, cut and joined at random."""
    r = random.Random(seed)
    words = []
    while len(words) < r.randrange(20, 900):
        block = [r.choice("abc"[: r.randrange(1, 4)]) + "x" * r.randrange(2) for _ in range(r.randrange(1, 40))]
        words += (block * r.randrange(1, 12))[: r.randrange(1, 400)]
        if r.random() < 0.3:
            words += words[r.randrange(len(words)) :]
    return words


def test_runs_equal_every_period():
    texts = [[w.encode() for w in repeating(s)] for s in range(300)] + [[], [b"a"], [b"a"] * 23, [b"a"] * 24, [b"a", b"b"] * 5000]
    ids, bounds = numbered(texts)
    got = runs_of(ids, bounds, 24, 3).tolist()
    want = [(int(bounds[t]) + s, n, q) for t, words in enumerate(texts) for (s, n), q in plain_runs(words).items()]
    assert len(want) > 300 and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize(("least", "times"), [(1, 3), (9, 3), (24, 4), (50, 5)])
def test_other_limits(least, times):
    texts = [[w.encode() for w in repeating(s)] for s in range(300, 380)]
    ids, bounds = numbered(texts)
    want = [(int(bounds[t]) + s, n, q) for t, words in enumerate(texts) for (s, n), q in plain_runs(words, least, times).items()]
    assert sorted(map(tuple, runs_of(ids, bounds, least, times).tolist())) == sorted(want)


def test_rows(spark):
    texts = [(t[0], t[1]) for t in odd_texts()] + [(100 + s, " ".join(repeating(s))) for s in range(40)] + [(200, "é ñ 日本 " * 40), (201, ("x y\n" * 12) + prose(1, 30))]
    got = periodic_runs(documents(spark, texts)).collect()
    assert sorted((tuple(r)[:-1] for r in got), key=repr) == sorted((plain(i, words_in(t)) for i, t in texts), key=repr)
    assert all(sha(r["collapsed"]) == r["collapsed_sha256"] for r in got)


def test_two_periods_are_refused(spark):
    with pytest.raises(ValueError):
        periodic_runs(documents(spark, []), times=2)


def test_long_texts_and_nothing(spark):
    block = prose(7, 50_000).split()
    one = " ".join(block * 4 + ["end"] * 300_000)
    got = periodic_runs(documents(spark, [(1, one)])).first()
    assert (got["n_runs"], got["start"], got["length"], got["period"], got["exponent_milli"]) == (2, 200_000, 300_000, 1, 300_000_000)
    assert got["collapsed"] == " ".join([*block, "end"])
    assert periodic_runs(documents(spark, [(1, "x")]).filter("false")).collect() == []


def test_registered(spark, sf):
    want = []
    for i, t in texts_of(spark, sf):
        words = words_in(t)
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, original = g % n, list(words)
            p = 1 + (n - a) // (3 + g % 8)
            for k in range(a, n):
                words[k] = original[a + (k - a) % p]
        want.append(plain(i, words))
    assert sorted(map(tuple, QUERIES["op12_periodic"](spark, sf).collect())) == sorted(want)
