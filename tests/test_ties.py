"""Values on a boundary come out the same in whatever order rows are added, and as the SQL has them."""

from __future__ import annotations

import pytest
from crossengine import compare
from pyspark.sql import functions as F

from tidewire.operators import health, relational
from tidewire.plans import ORACLES, QUERIES, items  # noqa: F401  it registers its queries


@pytest.mark.parametrize(("micros", "score"), [((225_000,), 0.999), ((100_000, 200_000, 375_000), 0.999), ((225_001,), 0.998), ((90_000_000,), 0.6)])
def test_scores_on_a_boundary(spark, micros, score):
    rows = spark.createDataFrame([("m", 1, m / 1000) for m in micros], "method string, success int, duration_ms double")
    got = health.method_scores(rows).first()
    assert (got["score"], got["success_rate"], got["n"]) == (score, 1.0, len(micros))


def test_scores_without_durations(spark):
    rows = spark.createDataFrame([("m", 1, None), ("m", 0, None), ("n", 1, 30_000.0), ("n", 0, None)], "method string, success int, duration_ms double")
    assert {r["method"]: (r["score"], r["mean_ms"]) for r in health.method_scores(rows).collect()} == {"m": (0.3, None), "n": (0.5, 30_000.0)}


@pytest.mark.parametrize("order", [[0.0, 0.6, 0.7, 0.7], [0.7, 0.0, 0.7, 0.6], [0.1, 0.5, 0.7, 0.7], [0.3, 0.4, 0.6, 0.7]])
def test_mean_reliability_on_a_boundary(spark, order):
    rows = [(1, None, r) for r in order] + [(2, None, r) for r in (0.6, 0.7, 0.8)] + [(3, 0.1, 0.9), (3, -0.40005, 0.9)]
    got = {r["id"]: r["bias"] for r in relational.fallback_bias(spark.createDataFrame(rows, "id long, bias double, reliability double").coalesce(1), "id").collect()}
    assert got == {1: 0.0, 2: 0.0, 3: -0.15}


def both(spark, folder, name, table, rows, schema):
    """What differs between a query and its SQL over a table of these rows."""
    import duckdb

    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return compare(QUERIES[name](spark, f"file://{folder}"), con, ORACLES[name])


def test_feeds_with_odd_titles(spark, tmp_path):
    titles = ["Etre", "A", "A &lt;b&gt;bold&lt;/b&gt; end", "&nbsp;Foo", "a < b > c", "<![CDATA[Hi there]]>", "<![CDATA[]]>", "&nbsp;", "&lt;p&gt;", "A longer title than those"]
    rows = [(i, f"http://odd{i % 3}.example.net/a/{i}", f"<html><title>{t}</title><body>x</body></html>") for i, t in enumerate(titles)]
    assert both(spark, tmp_path, "feed_rss_many", "pages", rows, "page_id long, url string, html string") is None


def test_words_of_any_alphabet(spark, tmp_path):
    """Where words begin and end is judged with all letters and marks: ßen is one word, é5 has no number, x2y neither."""
    from tidewire.operators import facts

    told = ["Großen Keit en Keit", "in~Paris ~in Rom", "é5 5é œ7 7% é7%", "$5 milé $6 MIL.", "4 DE MIÉRCOLES DE 2020 é3/4/2021", "Ángel Éber Ab\u0301 Cd ßAb Cd", "1.234.5x 12.345,6 1.2345", "bie\u0301en Ort"]
    rows = [(i, t) for i, t in enumerate(told)]
    assert both(spark, tmp_path, "facts_entity_kinds", "documents", rows, "doc_id long, text string") is None
    kinds = facts.entities_by_kind(F.col("text"))
    got = [{k: r[k] for k in kinds if r[k]} for r in spark.createDataFrame(rows, "doc_id long, text string").orderBy("doc_id").select(*[c.alias(k) for k, c in kinds.items()]).collect()]
    assert got[0] == {"place": ["en Keit"]} and got[1] == {"place": ["in Rom"]} and got[2] == {"number": ["7"], "percent": ["7%"]}
    assert got[3]["money"] == ["$5", "$6 MIL"] and got[4]["date"] == ["4 DE MIÉRCOLES DE 2020"] and "place" not in got[7]


def test_crowded_spots_do_not_meet_in_pairs(spark):
    """Three thousand points and as many places at three spots; before, the join alone made three million rows."""
    from tidewire.operators import places

    at = lambda i: (float(i % 3 * 40 - 40), float(i % 3 * 10))
    rows = lambda s: [(i, *at(i + s)) for i in range(3000)]
    points, held = spark.createDataFrame(rows(0), "k long, lat double, lng double"), spark.createDataFrame(rows(1), "id long, lat double, lng double")
    found = places.nearest_by_grid(points, held, "k", 8.0)
    assert {(r["k"], r["place_id"]) for r in found.collect()} == {(i, (i + 2) % 3) for i in range(3000)}
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_an_excerpt_before_a_long_end(spark):
    """What no sign ends is passed over once; before, it was searched from each of its characters."""
    from tidewire.functions import text

    told = ["One is here. Two is there, too, and longer than fifty letters in all! " + "x" * 400_000, "no sign " * 3, "Short. tail", "...", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(told)], "i long, t string")
    got = [r[0] for r in rows.orderBy("i").select(text.excerpt(F.col("t"))).collect()]
    assert got == ["One is here. Two is there, too, and longer than fifty letters in all!...", "no sign no sign no sign", "Short.", "...", ""]
