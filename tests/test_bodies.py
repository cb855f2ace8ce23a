from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewire.sources import bodies, markup
from tidewire.streaming import streams


@pytest.fixture(autouse=True)
def known(spark):
    bodies.register(spark)


def put(folder, name, rows, at=None):
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.writelines(r if isinstance(r, str) else json.dumps(r) + "\n" for r in rows)
    if at:
        os.utime(path, ns=(at, at))


def feed(i, n=1):
    items = "".join(f"<item><title>T{i}.{k}</title><link>http://h{i}/{k}?a=1&amp;b=2</link></item>" for k in range(n))
    return {"id": i, "url": f"http://h{i}/rss", "kind": "rss" if i % 2 else "atom", "body": f"<rss>{items}</rss>"}


@pytest.mark.parametrize("size", [1 << 25, 300, 7])
def test_byte_ranges_read_every_line_once(spark, tmp_path, size):
    put(tmp_path, "a.json", [feed(i, i % 4) for i in range(40)])
    put(tmp_path, "b.json", [feed(i) for i in range(40, 50)])
    put(tmp_path, "_c.json", [feed(99)])
    df = spark.read.format("bodies").option("range_bytes", size).load(f"file://{tmp_path}")
    assert sorted(r["id"] for r in df.collect()) == list(range(50))
    assert df.rdd.getNumPartitions() >= (2 if size > 1000 else 20)
    assert df.filter("id = 7").first()["body"] == feed(7, 3)["body"]


def test_conditions_reach_the_lines(spark, tmp_path):
    put(tmp_path, "a.json", [feed(i) for i in range(20)])
    df = spark.read.format("bodies").load(f"file://{tmp_path}")
    one = df.filter("kind = 'rss' AND id IN (3, 4, 5) AND url LIKE '%5%'")
    assert [r["id"] for r in one.collect()] == [5]
    assert df.filter("kind = 'rss'").filter("kind = 'atom'").count() == 0 and df.filter("kind <> 'rss'").count() == 10 and df.filter("kind is null").count() == 0
    reader = bodies.BodyReader("x", 1)
    left = list(reader.pushFilters([bodies.EqualTo(("kind",), "rss"), bodies.In(("id",), (3, 4)), bodies.IsNotNull(("kind",)), bodies.EqualTo(("url",), "u")]))
    assert reader.wanted == {"kind": {"rss"}, "id": {3, 4}} and left == [bodies.EqualTo(("url",), "u")]


def test_odd_lines_and_no_files(spark, tmp_path):
    put(tmp_path, "a.json", ["no json\n", "[1]\n", "\n", {"id": "x", "kind": None}, {"id": 1, "url": 5, "kind": "rss", "body": "é\n" * 3, "more": 1}])
    rows = spark.read.format("bodies").load(f"file://{tmp_path}").collect()
    assert sorted(map(tuple, rows), key=repr) == [(1, "5", "rss", "é\n" * 3), (None, None, None, None)]
    os.mkdir(f"{tmp_path}/none")
    assert spark.read.format("bodies").load(f"file://{tmp_path}/none").collect() == []
    with pytest.raises(Exception, match="path"):
        spark.read.format("bodies").load().collect()


def test_a_stream_takes_new_files_only(spark, tmp_path):
    folder, home = tmp_path / "in", streams.shared_folder(spark)
    folder.mkdir()
    put(folder, "b.json", [feed(1, 2), feed(2)], 1_000)

    def run():
        items = markup.rss_items(spark.readStream.format("bodies").load(f"file://{folder}").select(F.col("id").alias("feed_id"), "body"))
        return sorted(r["title"] for r in streams.drained(items.select("title", "url"), "append", home, f"bodies-{tmp_path.name}").collect())

    assert run() == ["T1.0", "T1.1", "T2.0"]
    put(folder, "a.json", [feed(3)], 2_000)
    assert run() == ["T1.0", "T1.1", "T2.0", "T3.0"] == run()
