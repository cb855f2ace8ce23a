from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.operators import textindex, vectors


def points(n, seed=2, size=8, groups=0):
    r = random.Random(seed)
    centres = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(groups)]
    return [(i, [x + r.gauss(0, 0.25) for x in r.choice(centres)] if groups else [r.uniform(-1, 1) for _ in range(size)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>").repartition(3)


def cosines(rows):
    x = np.array([v for _, v in rows], "float32").astype("float64")
    norm = np.linalg.norm(x, axis=1)
    return x @ x.T / (norm[:, None] * norm[None, :] + 1e-9)


@pytest.mark.parametrize("most", [(2_000, 20_000), (3, 7)])
def test_vectors_meet_in_blocks(spark, most):
    rows = points(60)
    v, s = table(spark, rows), cosines(rows)
    want = {(a, b) for a in range(0, 60, 5) for b in range(60) if a != b and s[a, b] >= 0.5}
    got = vectors.vector_scores(v.filter("id % 5 = 0"), v, least=0.5, most=most).collect()
    assert {(x["query_id"], x["id"]) for x in got} == want and len(got) == len(want)
    best = vectors.vector_scores(v.filter("id % 5 = 0"), v, k=4, most=most).collect()
    assert {(x["query_id"], x["id"]) for x in best} == {(a, b) for a in range(0, 60, 5) for b in sorted(set(range(60)) - {a}, key=lambda j: (-round(s[a, j], 9), j))[:4]}
    assert vectors.vector_scores(v.filter("false"), v, k=3).collect() == []
    odd = v.union(spark.createDataFrame([(None, [1.0] * 8), (77, None)], "id long, vector array<float>"))
    assert len(vectors.vector_scores(odd.filter("id % 5 = 0"), odd, least=0.5, most=most).collect()) == len(want)


def test_an_index_finds_what_it_promises(spark, tmp_path):
    rows = points(3000, groups=40)
    v = table(spark, rows)
    index = vectors.CellIndex.build(v.filter("id < 2000"), f"file://{tmp_path}/cells")
    index.append(v.filter("id >= 2000"))
    assert index.rows().count() == 3000 and index.rows().select("id").distinct().count() == 3000
    queries = v.filter("id % 50 = 0")
    exact = {(r["query_id"], r["id"]) for r in vectors.vector_scores(queries, v, k=10).collect()}
    opened = vectors.CellIndex.open(spark, f"file://{tmp_path}/cells")
    found = {(r["query_id"], r["id"]) for r in opened.search(queries, 10).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact) and opened.probes < len(opened.centres) / 2
    assert {(r["query_id"], r["id"]) for r in opened.search(queries, 10, probes=len(opened.centres)).collect()} == exact


def test_recall_on_the_table(spark, sf, tmp_path):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = v.filter("id % 50 = 0")
    exact = {(r["query_id"], r["id"]) for r in vectors.vector_scores(queries, v, k=10).collect()}
    found = {(r["query_id"], r["id"]) for r in vectors.CellIndex.build(v, f"file://{tmp_path}/cells").search(queries, 10).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_nothing_in_the_index(spark, tmp_path):
    v = table(spark, points(4))
    index = vectors.CellIndex.build(v, f"file://{tmp_path}/cells")
    assert index.search(v.filter("false")).collect() == [] and len(index.search(v, 10).collect()) == 12


def one_by_one(rows, least):
    """The rule itself: each free vector in order leads, and takes the later ones that are near and free."""
    s, ids, of = cosines(rows), [i for i, _ in rows], {}
    for a, i in enumerate(ids):
        if i not in of:
            of[i] = i
            for b in range(a + 1, len(ids)):
                if ids[b] not in of and s[a, b] >= least:
                    of[ids[b]] = i
    return of


@pytest.mark.parametrize(("least", "few", "groups"), [(0.85, 5, 12), (0.6, 5, 0), (0.3, 30, 0), (0.85, 20_000, 12)])
def test_leaders_equal_the_sequential_rule(spark, least, few, groups):
    rows = points(300, seed=5, groups=groups)
    rows += [(300 + i, rows[i][1]) for i in range(40)] + [(400, [0.0] * 8)]
    got = {r["id"]: r["leader"] for r in vectors.leaders(table(spark, rows), least, few=few).collect()}
    assert got == one_by_one(rows, least)


def shuffled(spark):
    """Rows that stages have written to shuffles so far."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.mark.parametrize(("least", "few"), [(0.85, 50), (0.3, 10)])
def test_leaders_send_no_copies_of_vectors(spark, monkeypatch, least, few):
    """Random vectors lie within reach of all cells; each of them is shuffled a few times, not once per cell."""
    rows = points(1500, seed=8)
    before = shuffled(spark)
    got = {r["id"]: r["leader"] for r in vectors.leaders(table(spark, rows), least, few=few).collect()}
    assert got == one_by_one(rows, least)
    assert shuffled(spark) - before < 40 * len(rows)
    monkeypatch.setattr(vectors, "BAND", 200)
    monkeypatch.setattr(vectors, "BLOCK", (90, 110))
    monkeypatch.setattr(vectors, "SCORES", 1000)
    assert {r["id"]: r["leader"] for r in vectors.leaders(table(spark, rows), least, few=few).collect()} == got


def test_blocks_of_clusters_are_passed_over():
    ids = np.arange(6)
    near, far = np.array([[1.0, 0.01 * i] for i in range(6)]), np.array([[0.01 * i, 1.0] for i in range(6)])
    assert [x.tolist() for x in vectors._first_near(ids + 6, far, ids, near, 0.85)] == [[], []]
    assert [x.tolist() for x in vectors._first_near(ids + 3, near, ids, near, 0.85)] == [[0, 1, 2, 3, 4, 5], [0] * 6]
    assert [x.tolist() for x in vectors._first_near(ids, near, ids, near, 0.85)] == [[1, 2, 3, 4, 5], [0] * 5]


@pytest.mark.parametrize("few", [8, 100])
def test_a_chain_of_neighbours(spark, few):
    """Each vector is near the one before and the one behind only: every second one leads."""
    rows = [(i, [math.cos(i * 0.5), math.sin(i * 0.5)] if i < 12 else [0.0, 0.0]) for i in range(12)]
    rows = [(i, [math.cos(i * 0.3), math.sin(i * 0.3)]) for i in range(20)]
    got = {r["id"]: r["leader"] for r in vectors.leaders(table(spark, rows), 0.95, few=few).collect()}
    assert got == one_by_one(rows, 0.95) and got == {i: i - i % 2 for i in range(20)}


def test_no_vectors(spark):
    assert vectors.leaders(table(spark, points(3)).filter("false")).collect() == []
    with pytest.raises(ValueError):
        vectors.leaders(table(spark, points(3)), 0)


def plain_search(texts, terms, most=10, k1=1.2, b=0.75):
    words = {i: [w for w in re.sub(r"\s+", " ", re.sub(r"[^a-z0-9_\s]", "", (t or "").lower())).strip().split(" ") if w] for i, t in texts}
    tf = {i: Counter(w) for i, w in words.items()}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(t for c in tf.values() for t in c)
    terms = list(dict.fromkeys(terms))
    hits = []
    for i, c in tf.items():
        if terms and all(c[t] for t in terms):
            part = lambda t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * (c[t] * (k1 + 1)) / (c[t] + k1 * (1 - b + b * len(words[i]) / mean))  # noqa: B023, E731
            hits.append((-round(sum(part(t) for t in terms), 4), i))
    return [(i, -s) for s, i in sorted(hits)[:most]]


def searched(index, spark, queries, **how):
    asked = spark.createDataFrame([(q, t) for q, t in enumerate(queries)], "query_id long, terms array<string>")
    return {q: sorted((r["id"], r["score"]) for r in index.search(asked, **how).collect() if r["query_id"] == q) for q in range(len(queries))}


def test_search_of_an_index_that_grows(spark, tmp_path):
    r = random.Random(1)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(30))]
    texts = [(i, " ".join(r.choices(vocabulary, [40, 20] + [30 / (k + 1) for k in range(30)], k=r.randrange(0, 60)))) for i in range(200)] + [(200, None), (201, ""), (202, "The, OF! w3-w4")]
    queries = [["the"], ["the", "w7"], ["w29", "w3", "of"], ["w1", "w1"], ["nowhere"], ["the", "nowhere"], [], ["w28", "w27"], ["w3w4"]]
    docs = spark.createDataFrame(texts, "id long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    index.append(docs.filter("id < 120"))
    near = lambda got, want: all(len(a) == len(b) and all(x[0] == y[0] and abs(x[1] - y[1]) < 2e-4 for x, y in zip(a, b, strict=True)) for a, b in zip(got, want, strict=True))
    assert near(searched(index, spark, queries).values(), [sorted(plain_search(texts[:120], q)) for q in queries])
    files = set(index.postings().inputFiles())
    index.append(docs.filter("id >= 120"))
    assert files < set(index.postings().inputFiles())
    assert near(searched(index, spark, queries).values(), [sorted(plain_search(texts, q)) for q in queries])
    assert near(searched(index, spark, queries, most=500).values(), [sorted(plain_search(texts, q, 500)) for q in queries])


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i % 50}") for i in range(500)], "id long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    index.append(docs)
    bucket = spark.range(1).select(index.bucket(F.lit("word7"))).first()[0]
    wanted = spark.createDataFrame([(bucket, "word7")], "bucket int, term string")
    plan = index.postings(wanted)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket", plan) and re.search(r"PushedFilters: \[.*term,word7", plan)
    assert index.postings(wanted).count() == index.postings(wanted, few=0).count() == 10


def test_rarest_terms(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c only"), (2, "a b c"), (3, "a b"), (4, "a"), (5, "")], "id long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    index.append(docs)
    assert {r["query_id"]: sorted(r["terms"]) for r in index.rarest_terms(docs, 2).collect()} == {1: ["b", "c"], 2: ["b", "c"], 3: ["a", "b"], 4: ["a"]}


def seen(docs):
    """``docs`` with a count of the times that a text is read."""
    times = docs.sparkSession.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(text):
        times.add(1)
        return text

    return docs.select("id", noted.asNondeterministic()("text").alias("text")), times


def test_texts_are_read_once_and_queries_of_the_same_terms_are_one(spark, tmp_path):
    rows = [(i, f"common rare{i // 3} {'x' * (i % 2)}") for i in range(60)] + [(60, ""), (61, None)]
    docs, times = seen(spark.createDataFrame(rows, "id long, text string"))
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    index.append(docs)
    assert times.value == 62
    queries, times = seen(spark.createDataFrame(rows, "id long, text string").filter("id < 6 or id > 59"))
    found = index.search(index.rarest_terms(queries, 2), 10).collect()
    assert times.value == 8
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], set()).add(r["id"])
    # Of 0 to 2 and 3 to 5 the terms are the own word and, at odd numbers, x, else the word common.
    assert by_query == {0: {0, 1, 2}, 1: {1}, 2: {0, 1, 2}, 3: {3, 5}, 4: {3, 4, 5}, 5: {3, 5}}
    assert sorted(tuple(r) for r in index.lengths().filter("id >= 60").collect()) == [(60, 0), (61, 0)]


@pytest.mark.parametrize("most", [textindex.COUNTED, 40])
def test_an_index_has_a_row_per_term_of_a_piece_of_texts(spark, tmp_path, most):
    rows = [(i, f"Common, rare{i // 2}  common\tx") for i in range(100)] + [(100, None), (101, " ,; "), (102, "common " * 50)]
    docs = spark.createDataFrame(rows, "id long, text string").coalesce(1)
    words = {i: [w for w in (t or "").lower().replace(",", "").replace(";", "").split()] for i, t in rows}
    want = sorted((t, i, n, len(w)) for i, w in words.items() for t, n in [("", 1), *Counter(w).items()])
    blocks = textindex.term_blocks(docs, most)
    assert sorted(tuple(r) for r in textindex.listed(blocks, "term").collect()) == want
    by_term = Counter(r["term"] for r in blocks.collect())
    assert by_term["common"] == 1 if most > 40 else 50 < by_term["common"] < 101
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    index.append(docs)
    # Of 307 postings and 103 documents: a row for each of the 52 words and one for the documents.
    assert index.postings().count() == len(want) - 103 and spark.read.parquet(f"{index.path}/postings").count() == 53


def test_no_documents_in_the_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index")
    index.append(docs.filter("id > 1"))
    index.append(docs)
    assert [tuple(r) for r in index.lengths().collect()] == [(1, 2)] and index.postings().count() == 2


@pytest.mark.parametrize("k", [1, 3, 7, 50])
def test_best_places_equal_a_full_sort(k):
    r = np.random.default_rng(3)
    s = np.round(r.uniform(-1, 1, (40, 20)), 1) + r.choice([0, 4e-10, -4e-10, 3e-9], (40, 20))
    s[r.uniform(size=s.shape) < 0.1], s[0], s[1, :18], s[2, 3] = -np.inf, -np.inf, np.nan, np.nan
    want = [(i, j) for i in range(40) for j in sorted(np.flatnonzero(np.isfinite(s[i])), key=lambda j: (-np.round(s[i, j], 9), j))[:k]]  # noqa: B023
    assert list(zip(*(x.tolist() for x in vectors.best_places(s, k)), strict=True)) == want


def test_a_search_of_all_cells_has_each_query_once(spark, tmp_path, monkeypatch):
    v = table(spark, points(300, groups=10))
    index = vectors.CellIndex.build(v, f"file://{tmp_path}/cells")
    queries, asked, meet = v.filter("id % 50 = 0"), [], vectors.meet
    monkeypatch.setattr(vectors, "meet", lambda a, *more, **how: asked.append(a.count()) or meet(a, *more, **how))
    got = index.search(queries, 10, probes=len(index.centres)).collect()
    exact = vectors.vector_scores(queries, v, k=10).collect()
    assert {(r["query_id"], r["id"]) for r in got} == {(r["query_id"], r["id"]) for r in exact} and len(got) == 60
    assert asked == [6, 6] and len(index.centres) > 6


def test_words_of_odd_characters(spark):
    """Every character below U+3000, alone and between letters, by the rule itself."""
    from tidewire.functions import text

    chars = [chr(i) for i in range(1, 0x3000)] + ["\U0001f600", "\u212a", "\u3000"]
    plain = str.maketrans(text.ACCENTED, text.PLAIN)
    texts = [f" {c}a{c}{c}B \t{c} \n {c}_" for c in chars]
    lowered = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("text", F.lower("text").alias("low"), text.normalise(F.col("text")).alias("n"), text.words(F.col("text")).alias("w")).collect()
    for r in lowered:
        want = re.sub(r"[ \t-\r]+", " ", re.sub(r"[^a-z0-9_ \t-\r]", "", r["low"].translate(plain))).strip(" ")
        assert r["n"] == want and r["w"] == [w for w in want.split(" ") if w], ascii(r["text"])
