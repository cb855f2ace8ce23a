from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text, urls
from tidewire.operators import places, relational


@pytest.mark.parametrize("cell", [0.5, 7.0, 1000.0])
def test_the_grid_equals_the_array(spark, cell):
    r = random.Random(3)
    there = [(i, r.choice([r.uniform(-90, 90), r.randrange(-3, 3)]), r.choice([r.uniform(-180, 180), r.randrange(-3, 3)])) for i in range(120)] + [(900 + i, 50.0, 60.0) for i in range(3)]
    here = [(i, float(r.randrange(-90, 90)), float(r.randrange(-180, 180))) for i in range(150)] + [(500, 50.0, 60.0), (501, -1.0, -1.0), (502, 89.9, 179.9)]
    p, q = spark.createDataFrame(here, "k long, lat double, lng double"), spark.createDataFrame([(i, float(a), float(b)) for i, a, b in there], "id long, lat double, lng double")
    got = sorted(map(tuple, places.nearest_by_grid(p, q, "k", cell).collect()))
    assert got == sorted(map(tuple, relational.nearest(p, q).select("k", "place_id").collect())) and len(got) == len(here)


def test_the_grid_of_few(spark):
    q = spark.createDataFrame([(7, 80.0, -170.0), (8, None, 1.0)], "id long, lat double, lng double")
    p = spark.createDataFrame([(1, -80.0, 170.0), (2, None, 0.0), (3, 80.0, 179.0)], "k long, lat double, lng double")
    assert sorted(map(tuple, places.nearest_by_grid(p, q, "k").collect())) == [(1, 7), (3, 7)]
    assert places.nearest_by_grid(p, q.filter("false"), "k").collect() == [] == places.nearest_by_grid(p.filter("false"), q, "k").collect()


def test_a_tree_of_places(spark):
    rows = [(1, "country", None), (2, "province", 1), (3, "county", 2), (4, "city", 3), (5, "quarter", 4), (6, "lost", 99), (7, "below", 6), (8, "a", 9), (9, "b", 10), (10, "c", 8), (11, "on a cycle", 9), (12, "self", 12), (13, "alone", None)]
    got = {r["id"]: (r["root_id"], r["depth"], r["path"], r["status"]) for r in places.tree_paths(spark.createDataFrame(rows, "id long, name string, parent_id long")).collect()}
    assert got[5] == (1, 4, "country > province > county > city > quarter", "ok") and got[1] == (1, 0, "country", "ok") and got[13] == (13, 0, "alone", "ok")
    assert {i for i, v in got.items() if v[3] == "orphan"} == {6, 7} and {i for i, v in got.items() if v[3] == "cycle"} == {8, 9, 10, 11, 12} and len(got) == len(rows)


def test_a_long_chain(spark):
    rows = [(i, f"n{i}", i - 1 if i else None) for i in range(100)]
    got = places.tree_paths(spark.createDataFrame(rows, "id long, name string, parent_id long"))
    assert got.filter("depth != id or root_id != 0 or status != 'ok'").collect() == [] and got.count() == 100


def test_letters_without_marks(spark):
    texts = ["Žluťoučký ŁÓDŹ ŷ ā", "ñandú ß 日本 é", "", None, "plain", "é"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(text.to_ascii("t")).collect()]
    assert got == [None if t is None else unicodedata.normalize("NFD", t).encode("ascii", "ignore").decode() for t in texts]
    assert got[0] == "Zlutoucky ODZ y a"
    pair = spark.createDataFrame([("Žluť", "zlut", True), ("ŷā", "YA", True), ("ab", "ac", False)], "a string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in pair.select("want", text.same_letters(F.col("a"), F.col("b")).alias("got")).collect())


def test_links_on_a_page(spark):
    from urllib.parse import urljoin

    bases = ["https://h.com/dir/page.html", "http://h.com", "http://h.com/a/b/c/?q=1#x", "https://h.com:8080/p?x=/y/z"]
    hrefs = ["news.xml", "//cdn.x/f.xml", "/feed", "../up.xml", "../../../top", "./here/./now", "https://o.org/a/../b", "?page=2", "#top", "a/b/..", "x?y=../z", " spaced "]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string").select("base", "href", urls.resolved(F.col("href"), F.col("base")).alias("got")).collect()
    for r in rows:
        if not (r["href"].startswith("https://")):
            assert r["got"] == urljoin(r["base"], r["href"].strip()), r
