from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from edge import documents, odd_texts, prose
from test_registered import texts_of

from tidewire.llm.queries import QUERIES
from tidewire.llm.simhash import close_links, fingerprint, simhash_classes


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(numbers):
    """The smallest index that links of two bits or fewer reach, for each."""
    root = list(range(len(numbers)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    u = np.asarray(numbers, "u8")
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= 2).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            root[b] = a
    return [find(i) for i in range(len(u))]


def brute(texts):
    rows = sorted(texts, key=lambda t: (t[0] is None, t[0] or 0))
    numbers = [plain_fingerprint(t) for _, t in rows]
    return sorted(((i, f"{n:016x}", rows[r][0]) for (i, _), n, r in zip(rows, numbers, linked(numbers), strict=True)), key=repr)


def test_fingerprints():
    for t in [None, "", " \n", "One", "one Two", "a b c", "É é À x", "x " * 70_000, prose(4, 300)]:
        assert fingerprint(t or "") & (2**64 - 1) == plain_fingerprint(t)


@pytest.mark.parametrize("crowd", [64, 2])
def test_classes_equal_brute_force(spark, crowd):
    base = prose(5, 400).split()
    near = []
    for i in range(60):
        words = list(base)
        words[i * 6 : i * 6 + 1] = [f"w{i}"] * (i % 3)
        near.append((100 + i, " ".join(words)))
    texts = [(t[0], t[1]) for t in odd_texts()] + near + [(i, base[i % 5]) for i in range(300, 330)]
    got = sorted(map(tuple, simhash_classes(documents(spark, texts), crowd=crowd).collect()), key=repr)
    assert got == brute(texts)
    assert len({c for i, _, c in got if i and 100 <= i < 160}) < 60


@pytest.mark.parametrize("crowd", [64, 3])
def test_links_connect_what_all_pairs_do(spark, crowd):
    """Chains and balls: numbers within two bits of each other, some halves shared by many, bits 31, 32 and 63 among them."""
    r = random.Random(3)
    numbers = set()
    for _ in range(6):
        x = r.getrandbits(64)
        numbers.update(x ^ (1 << b) for b in (0, 31, 32, 33, 63))
        for _ in range(40):
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
            numbers.add(x)
            numbers.add(x ^ (r.getrandbits(3) << 61))
    numbers = sorted(numbers)
    nodes = spark.createDataFrame([(int(np.uint64(n).astype("int64")),) for n in numbers], "fp long")
    links = [(int(np.int64(a).astype("uint64")), int(np.int64(b).astype("uint64"))) for a, b in close_links(nodes, crowd).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in links)
    at = {n: i for i, n in enumerate(numbers)}
    root = list(range(len(numbers)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(at[a]), find(at[b])))
        root[y] = x
    assert [find(i) for i in range(len(numbers))] == linked(numbers)


@pytest.mark.parametrize("crowd", [64, 3])
def test_no_index_is_broadcast(spark, tmp_path, crowd):
    """A file of 2,000 fingerprints is small, its 66,000 variants of each side are not for Spark to size."""
    x, folder = random.Random(1), f"file://{tmp_path}/nodes"
    numbers = [(x.getrandbits(64) - 2**63 if i % 10 else i << 32,) for i in range(2000)]
    spark.createDataFrame(numbers, "fp long").write.parquet(folder)
    plan = close_links(spark.read.parquet(folder), crowd)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "Inner" in line]
    assert joins and all("SortMergeJoin" in line for line in joins), joins


def test_nothing(spark):
    assert simhash_classes(documents(spark, [(1, "x")]).filter("false")).collect() == []


def test_long_text(spark):
    one = " ".join(prose(s, 40) for s in range(8_000))
    got = {r["doc_id"]: r["component_id"] for r in simhash_classes(documents(spark, [(3, one), (2, one + " tail"), (9, "other words of a text")])).collect()}
    assert got == {3: 2, 2: 2, 9: 9}


def test_registered(spark, sf):
    assert sorted(map(tuple, QUERIES["op11_simhash"](spark, sf).collect()), key=repr) == brute(texts_of(spark, sf))
