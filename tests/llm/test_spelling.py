from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from crossengine import compare, connect
from edge import documents, odd_texts, prose

from tidewire.llm.oracles import ORACLES
from tidewire.llm.queries import QUERIES, misspelt
from tidewire.llm.spelling import affected, decomposed, listed, near_words, one_apart, spelling_variants


def apart(a, b):
    """Whether one inserted, deleted or replaced character makes the words equal."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    near = {w: [v for v in counts if apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= ratio * counts[w] else None
    root = {}
    for w in counts:
        at = w
        while form[at]:
            at = form[at]
        root[w] = at
    return sorted(((w, form[w], root[w], n, len(near[w]), form[w] and counts[form[w]]) for w, n in counts.items()), key=repr)


def similar_words(seed, n, letters="abé"):
    r = random.Random(seed)
    words = set()
    while len(words) < n:
        w = [r.choice(letters) for _ in range(r.randrange(6, 11))]
        for _ in range(4):
            words.add("".join(w))
            i = r.randrange(len(w))
            w[i : i + r.randrange(2)] = [r.choice(letters)] * r.randrange(2)
            if len(w) < 6:
                break
    return sorted(words)[:n]


@pytest.mark.parametrize("common", [{}, {"<a": 9, "ab": 9, "aba": 3, "bé": 40, "béa": 2, "éa": 7, "éaé": 1, "aaa": 99, "aa": 100, "a>": 5}])
def test_bounds_hold(common):
    """Of the grams of a word all but its bound are left, where they were or counted from the end, in any word one change apart."""
    for word in similar_words(1, 150):
        own = decomposed(word, common, 2, 6)
        bound = affected(own)
        assert bound < len(own)
        for i in range(len(word) + 1):
            for other in {word[:i] + c + word[i + d :] for c in ("", "a", "b", "é", "x") for d in (0, 1)} - {word}:
                if not apart(word, other):
                    continue
                theirs = decomposed(other, common, 2, 6)
                shift = len(theirs) - len(own)
                left = sum(1 for at, g in enumerate(own) if (at < len(theirs) and theirs[at] == g) or (0 <= at + shift < len(theirs) and theirs[at + shift] == g))
                assert left >= max(len(own) - bound, len(theirs) - affected(theirs))
                mine = {(g, at) for at, g in listed(word, common, 2, 6)}
                assert any({(g, at), (g, at - shift)} & mine for at, g in listed(other, common, 2, 6))


@pytest.mark.parametrize("how", [{}, {"most": 40}, {"crowd": 1}, {"most": 40, "crowd": 3}])
def test_near_words_equal_brute_force(spark, how):
    words = similar_words(2, 700)
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    at = {w: i for i, w in enumerate(words)}
    got = sorted(map(tuple, near_words(table, **how).collect()))
    assert got == sorted((a, at[a], b, at[b]) for a in words for b in words if apart(a, b))


def test_one_apart(spark):
    words = similar_words(3, 200)
    pairs = [(r["word"], r["other"]) for r in one_apart(spark.createDataFrame([(w, 1) for w in words], "word string, n long")).distinct().collect()]
    assert len(pairs) == len(set(map(frozenset, pairs))) and {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if apart(a, b)}


def word_texts():
    r = random.Random(4)
    words = similar_words(5, 120)
    texts = [(t[0], t[1]) for t in odd_texts()]
    for i in range(60):
        texts.append((500 + i, " ".join(w.upper() if r.random() < 0.1 else w for w in words for _ in range(int(r.paretovariate(0.7)) % 60))))
    return texts + [(600, "ÀÉÎÕÜß×÷ÿ " * 7 + "Àéîõüß " * 3), (601, "internatiönal, internatiönel; internatiönl/internatiönal " * 30), (602, prose(1, 20))]


@pytest.mark.parametrize("altered", [None, misspelt])
def test_groups_equal_brute_force(spark, altered):
    counts = Counter()
    texts = word_texts()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if altered and h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = sorted(map(tuple, spelling_variants(documents(spark, texts), altered=altered).collect()), key=repr)
    assert got == brute(counts)


def test_forms_lead_on(spark):
    """Eight words in a chain, each five times as frequent as the one before."""
    chain = ["abcdef" + "xyzuvwts"[:i] for i in range(8)]
    counts = spark.createDataFrame([(i, " ".join([w] * (5 ** min(i + 1, 6)))) for i, w in enumerate(chain[:6])], "doc_id long, text string")
    rows = {r["word"]: r["root"] for r in spelling_variants(counts).collect()}
    assert rows == {w: chain[5] for w in chain[:6]}


def test_gram_length_has_a_bound(spark):
    with pytest.raises(ValueError):
        near_words(spark.createDataFrame([], "word string, n long"), 5)


def test_nothing_and_a_long_text(spark):
    assert spelling_variants(documents(spark, [(1, "x")]).filter("false")).collect() == []
    one = "variant " * 400_000 + "varient " * 5
    assert sorted(map(tuple, spelling_variants(documents(spark, [(1, one)])).collect())) == [("variant", None, "variant", 400_000, 1, None), ("varient", "variant", "variant", 5, 1, 400_000)]


def test_registered(spark, sf):
    assert compare(QUERIES["op13_spelling"](spark, sf), connect(sf), ORACLES["op13_spelling"]) is None
