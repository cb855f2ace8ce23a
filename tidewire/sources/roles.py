"""The supplied tables seen as cards, attempts, locations, sources and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Reference times of the queries.
ORDERS_AS_OF, EVENTS_AS_OF = "2001-08-01 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(value: Column) -> Column:
    return value.cast("double") / 100


def cards(spark: SparkSession, sf_dir: str, placed: bool = False) -> DataFrame:
    """Cards; with location_id, which takes a join with their sources, only if ``placed``."""
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        key.alias("id"),
        F.col("o_custkey").alias("source_id"),
        F.col("o_orderstatus").alias("category"),
        hundredths((key * 37) % 201 - 100).alias("bias_signed"),
        F.when(key % 7 != 0, hundredths((key * 13) % 101)).alias("quality"),
        F.when(key % 11 == 0, 1).otherwise(0).alias("is_press"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("cluster_id"),
        F.col("o_orderdate").alias("created_at"),
        "o_totalprice",
    )
    return with_places(rows, spark, sf_dir).drop("o_totalprice") if placed else rows


def with_places(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rows`` with the location_id of their source."""
    places = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("location_id"))
    return rows.join(places, "source_id", "left")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("source_key"),
        F.col("event_type").alias("method"),
        (F.col("value") * 100).alias("duration_ms"),
        F.when((F.col("event_type") == "error") | (F.col("event_id") % 5 == 0), 0).otherwise(1).alias("success"),
        "ts",
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1000).alias("id"), F.col("r_name").alias("name"), F.lit("region").alias("type"), F.lit(None).cast("int").alias("parent_id"))
    return top.union(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit("nation"), F.col("n_regionkey") + 1000))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("lang").alias("category"),
        F.col("source").alias("source_name"),
        F.left("text", F.lit(60)).alias("title"),
        F.left("text", F.lit(280)).alias("summary"),
        F.col("text").alias("body"),
        F.col("quality").alias("quality_flag"),
        F.col("toxic").alias("press_flag"),
    )
