from __future__ import annotations

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tidewire.operators import clusters, facts, relational
from tidewire.sources import connectors


def words(title):
    return {w for w in title.split() if len(w) >= 3}


def greedy(rows, least=0.5, members=4):
    """The assignment in plain Python, batch by batch."""
    out = {}
    for batch in sorted({b for b, _, _ in rows}):
        found = []
        for _, i, title in sorted(r for r in rows if r[0] == batch):
            own = words(title)
            means = [sum(len(own & s) / len(own | s) if own and s else 0.0 for s in sets) / len(sets) for _, sets in found]
            best = max(means, default=0.0)
            if best > 0 and best >= least:
                n = means.index(best)
            else:
                found.append((i, []))
                n = len(found) - 1
            if len(found[n][1]) < members:
                found[n][1].append(own)
            out[i] = found[n][0]
    return out


def test_greedy_equals_plain_python(spark):
    names = ["red green blue black", "red green blue white", "red green grey white", "one two three four", "one two three five", "", "zz"]
    rows = [(i // 20, i, names[(i * 5 + i // 3) % 7]) for i in range(60)]
    want = greedy(rows)
    got = {r["id"]: r["cluster_id"] for r in clusters.greedy(spark.createDataFrame(rows, "batch long, id long, title string")).collect()}
    firsts = {i: f for i, f in want.items()}
    assert set(got) == set(firsts)
    assert all((got[a] == got[b]) == (firsts[a] == firsts[b]) for a in got for b in got)


def test_registered_greedy_equals_plain_python(spark, sf):
    from tidewire.functions.text import normalise
    from tidewire.sources.roles import texts

    rows = [(r["id"] // 500, r["id"], r["title"] or "") for r in texts(spark, sf).select("id", normalise(F.col("title")).alias("title")).collect()]
    want = greedy(rows)
    got = {r["id"]: r["cluster_id"] for r in entry_point.queries()["clu_greedy"](spark, sf).collect()}
    assert set(got) == set(want)
    assert len(set(got.values())) == len(set(want.values()))
    assert len({(got[i], want[i]) for i in got}) == len(set(want.values()))


def test_followed_sources(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "source_id long")
    assert rows.filter(relational.card_filter("2024-01-01", sources=[1, 3])).count() == 2
    assert rows.filter(relational.card_filter("2024-01-01", sources=[])).count() == 3


def test_connectors_read_what_was_fetched(spark):
    rss = "<rss><item><title>a</title><link>http://x/a</link></item></rss>"
    maps = "<urlset><url><loc>http://x/some-page.html</loc></url></urlset>"
    page = "<html><title>A page</title><body>" + "word " * 40 + "</body></html>"
    rows = [(1, "rss", "http://x", rss), (1, "sitemap", "http://x", maps), (2, "article", "http://y", page), (3, "rss", "ftp://z", rss), (4, "reader", "http://x/no-title", '{"data": {"content": "text"}}')]
    fetched = spark.createDataFrame(rows, "id long, connector string, url string, body string")
    found = connectors.harvest(fetched)
    assert {tuple(r) for r in found.collect()} == {(1, "rss", "a", "http://x/a"), (1, "sitemap", "Some Page", "http://x/some-page.html"), (2, "article", "A page", "http://y"), (4, "reader", "No Title", "http://x/no-title")}
    results = found.groupBy("id", "connector").agg(F.count("*").alias("n_items"))
    learned = spark.createDataFrame([(1, "sitemap")], "id long, learned string")
    none = spark.createDataFrame([], "id long, connector string")
    used = lambda l, o: {r["id"]: r["connector"] for r in connectors.first_result(results, "id", l, o).collect()}
    assert used(learned.limit(0), none) == {1: "rss", 2: "article", 4: "reader"}
    assert used(learned, none)[1] == "sitemap"
    assert used(learned, none.union(spark.createDataFrame([(1, "sitemap")], "id long, connector string")))[1] == "rss"


def test_a_connector_of_ones_own(spark):
    own = connectors.Connector("plain", 9, lambda u: F.lit(True), lambda b: b.select("id", F.col("body").alias("title"), "url"))
    connectors.register(own)
    try:
        fetched = spark.createDataFrame([(7, "plain", "u", "hello")], "id long, connector string, url string, body string")
        assert [tuple(r) for r in connectors.harvest(fetched).collect()] == [(7, "plain", "hello", "u")]
    finally:
        del connectors.CONNECTORS["plain"]


def test_a_signature_is_made_once_of_each_title(spark):
    times = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def noted(title):
        times.add(1)
        return title

    rows = spark.createDataFrame([(1, "Storms over Lisbon"), (2, "lisbon: STORMS over"), (3, "Calm seas"), (4, ""), (5, "a b"), (6, None)], "id long, title string")
    found = clusters.by_signature(rows.select("id", noted.asNondeterministic()("title").alias("title"))).collect()
    assert times.value == 6
    assert sorted(r["id"] for r in found) == [1, 2] and len({r["cluster_id"] for r in found}) == 1


def test_the_key_of_a_sentence_is_made_once(spark):
    articles = spark.createDataFrame([("b", 2, 0.5, "Storms over  Lisbon! Calm seas\tbehind... short. ¿¿¿¿¿¿ ¿¿¿¿¿¿?"), ("b", 1, 0.1, "x. STORMS, over Lisbon"), ("a", 3, 0.0, "storms over lisbon"), ("a", 4, 0.0, None)], "cluster_id string, id long, bias double, text string")
    found = facts.facts(facts.sentence_rows(articles))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 1
    assert sorted(tuple(r) for r in found.select("cluster_id", "rank", "key", "frequency", "sentence", "bias_avg").collect()) == [
        ("a", 1, "storms over lisbon", 1, "storms over lisbon", 0.0),
        ("b", 1, "storms over lisbon", 2, "STORMS, over Lisbon", 0.3),
        ("b", 2, "calm seas behind", 1, "Calm seas behind", 0.5),
    ]
