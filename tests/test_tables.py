from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewire.operators import ingest
from tidewire.operators.tables import KeyedTable
from tidewire.streaming import streams

SCHEMA = "id long, name string, version int"


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, f"file://{tmp_path}/table", spark.createDataFrame([], SCHEMA).schema, "id", buckets=16)
    made.keep_latest(spark.createDataFrame([(i, f"n{i}", 1) for i in range(400)], SCHEMA), F.col("version"))
    return made


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def files(table):
    return set(table.read().inputFiles())


def test_untouched_files_stay(spark, table):
    before, old = files(table), table.read().collect()
    batch = spark.createDataFrame([(7, "new", 2), (8, "older", 0), (1000, "added", 1), (7, "newest", 3)], SCHEMA)
    table.keep_latest(batch, F.col("version"))
    buckets = {r[0] for r in batch.select(table.bucket()).distinct().collect()}
    untouched = {f for f in before if int(f.rsplit("bucket=", 1)[1].split("/")[0]) not in buckets}
    assert untouched and files(table) & before == untouched and 0 < len(buckets) <= 3
    want = ingest.keep_latest(spark.createDataFrame(old, SCHEMA), batch, "id", F.col("version"))
    assert rows_of(table.read()) == rows_of(want.select("id", "name", "version"))


def test_every_change(spark, table):
    table.insert_absent(spark.createDataFrame([(1, "x", 9), (500, "b", 2), (500, "a", 1)], SCHEMA), F.col("version"))
    table.upsert(spark.createDataFrame([(2, "two"), (501, "fresh")], "id long, name string"), {"version": F.lit(5)})
    table.enrich(spark.createDataFrame([(3, None, 7), (4, "four", None), (999, "no", 1)], SCHEMA))
    table.delete(spark.createDataFrame([(5,), (998,)], "id long"))
    got = {r["id"]: (r["name"], r["version"]) for r in table.read().collect()}
    want = {i: (f"n{i}", 1) for i in range(400)} | {500: ("a", 1), 2: ("two", 1), 501: ("fresh", 5), 3: ("n3", 7), 4: ("four", 1)}
    del want[5]
    assert got == want and table.read().count() == len(want)


def test_readers_see_a_change_whole_or_not_at_all(spark, table):
    reader, before = table.read(), rows_of(table.read())

    def stops(old, new):
        return old.union(new).withColumn("version", F.raise_error(F.lit("stopped")).cast("int"))

    with pytest.raises(Exception, match="stopped"):
        table.change(spark.createDataFrame([(1, "x", 9)], SCHEMA), stops)
    assert rows_of(table.read()) == before and table.numbers() == [0]
    table.keep_latest(spark.createDataFrame([(1, "x", 9)], SCHEMA), F.col("version"))
    assert rows_of(reader) == before == rows_of(table.read(0)) and table.numbers() == [0, 1]
    for v in range(10, 13):
        table.keep_latest(spark.createDataFrame([(1, "x", v)], SCHEMA), F.col("version"))
    table.clear()
    assert table.read().filter("id = 1").first()["version"] == 12 and table.read().count() == 400
    assert table.read(3).filter("id = 1").first()["version"] == 11


def test_a_bucket_may_become_empty(spark, table):
    table.delete(table.read())
    assert table.read().collect() == [] and table.manifest() == {}
    table.keep_latest(spark.createDataFrame([(1, "x", 9), (None, "none", 1)], SCHEMA), F.col("version"))
    assert rows_of(table.read()) == [(1, "x", 9), (None, "none", 1)]
    table.keep_latest(spark.createDataFrame([], SCHEMA), F.col("version"))
    assert table.read().count() == 2


def test_strange_keys_are_refused(spark, table):
    with pytest.raises(ValueError, match="does not have"):
        table.change(spark.createDataFrame([(1, "x", 9)], SCHEMA), lambda old, new: old.union(spark.createDataFrame([(i, "x", 9) for i in range(900, 950)], SCHEMA)))


def test_a_stream_that_is_run_again_changes_once(spark, table, tmp_path):
    events = f"{tmp_path}/in"
    for n in range(2):
        spark.createDataFrame([(i, "s", 10 + n) for i in range(3)], SCHEMA).coalesce(1).write.mode("append").parquet(events)
    calls = []

    def add(batch, number):
        table.change(batch, lambda old, new: old.join(new.select("id", F.col("version").alias("more")), "id", "left").select("id", "name", (F.col("version") + F.coalesce("more", F.lit(0))).alias("version")), f"stream-{number}")
        calls.append(number)
        if calls == [0, 1]:
            raise RuntimeError("stopped between the sink and the commit")

    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(events)
    with pytest.raises(Exception, match="stopped between"):
        streams.run_through(stream, "append", f"file://{tmp_path}/state", add)
    streams.run_through(stream, "append", f"file://{tmp_path}/state", add)
    assert calls == [0, 1, 1] and {r["version"] for r in table.read().filter("id < 3").collect()} == {22}
