"""Tables that are changed by key: what a batch does not touch is neither read nor written.

Rows lie in folders by a hash of the key. A change writes the folders of the batch's keys
under a new number, and then a manifest that names, for each folder, the number to read.
Readers take the newest complete manifest, so they see a change whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewire.streaming.streams import versions

#: Folders of a table at most: their list goes through the driver.
MOST_BUCKETS = 65_536


@dataclass
class KeyedTable:
    """Rows of ``schema`` by ``key`` in a folder that driver and executors share; one writer at a time."""

    spark: SparkSession
    path: str
    schema: StructType
    key: str
    buckets: int = 64

    def __post_init__(self) -> None:
        if not 0 < self.buckets <= MOST_BUCKETS:
            raise ValueError(f"buckets must be 1 to {MOST_BUCKETS}")

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def numbers(self) -> list[int]:
        """The changes that are complete, oldest first."""
        return versions(self.spark, f"{self.path}/manifests")

    def manifest(self, number: int | None = None) -> dict[int, int]:
        """Folder -> change that wrote it, after change ``number``, the latest by default."""
        done = self.numbers()
        if not done:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifests/{done[-1] if number is None else number}").collect()
        return {r["bucket"]: r["number"] for r in rows if r["bucket"] is not None}

    def _rows(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/{n}/bucket={b}" for b, n in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The table now, or as it was after a change that has not been cleared."""
        return self._rows(self.manifest(number))

    def change(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], token: str = "") -> int:
        """Replaces the rows of the batch's folders by merge(old rows, batch); returns the change's number.

        A batch with a ``token`` that one of the last ten changes had is not merged again, so a
        stream may give the numbers of its batches. Two writers that start from the same change collide:
        the later one fails and leaves nothing that is read.
        """
        done = self.numbers()
        number = done[-1] + 1 if done else 0
        if token and done and not self.spark.read.parquet(*[f"{self.path}/manifests/{n}" for n in done[-10:]]).filter(F.col("token") == token).isEmpty():
            return done[-1]
        touched = [r[0] for r in batch.select(self.bucket()).distinct().collect()]  # at most ``buckets`` rows
        before = self.manifest()
        old = self._rows({b: before[b] for b in touched if b in before})
        new = merge(old, batch).select(*self.schema.fieldNames())
        folder = f"{self.path}/data/{number}"
        new.withColumn("bucket", self.bucket()).repartition(len(touched) or 1, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        # A folder whose rows are all gone is not there.
        left = {r[0] for r in self.spark.read.parquet(folder).select("bucket").distinct().collect()} if self._any(folder) else set()
        if not left <= set(touched):
            raise ValueError("merge made rows of keys that the batch does not have")
        after = {b: n for b, n in before.items() if b not in touched} | dict.fromkeys(left, number)
        rows = [(b, n, token) for b, n in sorted(after.items())] or [(None, number, token)]
        self.spark.createDataFrame(rows, "bucket int, number int, token string").coalesce(1).write.mode("error").parquet(f"{self.path}/manifests/{number}")
        return number

    def _any(self, folder: str) -> bool:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket=*")
        return bool(where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))

    def clear(self, keep: int = 2) -> None:
        """Deletes the folders that none of the last ``keep`` changes reads. Manifests, a few rows each, stay with their tokens."""
        done = self.numbers()
        last = done[-keep:]
        used = {(b, n) for number in last for b, n in self.manifest(number).items()}
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for number in done[:-keep]:
            for b, n in self.manifest(number).items():
                if (b, n) not in used:
                    fs.delete(path(f"{self.path}/data/{n}/bucket={b}"), True)

    # ---- changes

    def keep_latest(self, batch: DataFrame, *version: Column, token: str = "") -> int:
        """Of each key the row with the greatest version, of the table's and the batch's."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            rows = old.unionByName(new.select(*old.columns))
            others = F.struct(*[c for c in old.columns if c != self.key])
            return rows.groupBy(self.key).agg(F.max_by(others, F.struct(*version)).alias("_row")).select(self.key, "_row.*")

        return self.change(batch, merge, token)

    def insert_absent(self, batch: DataFrame, *order: Column, token: str = "") -> int:
        """Of each key that the table lacks the batch's first row."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            others = F.struct(*[c for c in old.columns if c != self.key])
            first = new.groupBy(self.key).agg(F.min_by(others, F.struct(*order)).alias("_row")).select(self.key, "_row.*")
            return old.unionByName(first.join(old.select(self.key), self.key, "left_anti").select(*old.columns))

        return self.change(batch, merge, token)

    def upsert(self, batch: DataFrame, defaults: dict[str, Column] | None = None, token: str = "") -> int:
        """The batch's values where it has the column, of a key at most one row; rows of new keys take ``defaults`` for the others."""
        names = [c for c in batch.columns if c != self.key]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            named = new.select(self.key, *[F.col(c).alias(f"_new_{c}") for c in names], F.lit(True).alias("_there"))
            joined = old.withColumn("_known", F.lit(True)).join(named, self.key, "full")
            absent = lambda c: F.when(F.col("_known"), F.col(c)).otherwise((defaults or {}).get(c, F.lit(None)))
            return joined.select(self.key, *[F.when(F.col("_there"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in names else absent(c).alias(c) for c in old.columns if c != self.key])

        return self.change(batch, merge, token)

    def enrich(self, batch: DataFrame, token: str = "") -> int:
        """The batch's values where they are not null, for keys that are there."""

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            names = [c for c in new.columns if c != self.key]
            joined = old.join(new.select(self.key, *[F.col(c).alias(f"_new_{c}") for c in names]), self.key, "left")
            return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])

        return self.change(batch, merge, token)

    def delete(self, keys: DataFrame, token: str = "") -> int:
        """Rows of these keys go."""
        return self.change(keys.select(self.key), lambda old, gone: old.join(gone, self.key, "left_anti"), token)
