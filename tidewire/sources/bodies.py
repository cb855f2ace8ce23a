"""A data source for bodies that a fetcher has left in a folder: ``spark.read.format("bodies")``.

Files hold a JSON object per line: id, url, kind (rss, atom, sitemap, json, html ...), body.
They are read by byte ranges, a line by the range it begins in; as a stream, files come in
order of their time of arrival. The functions of tidewire.sources.markup make items of them.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "id long, url string, kind string, body string"
ARROW = pa.schema([("id", pa.int64()), ("url", pa.string()), ("kind", pa.string()), ("body", pa.string())])


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """A folder on any file system that Arrow knows by its URI."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def listed(uri: str) -> list[tuple[int, str, int]]:
    """(time of arrival in ns, path, bytes) of the folder's files, oldest first; names that begin with . or _ are not data."""
    system, root = opened(uri)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def ranges(files: Iterable[tuple[int, str, int]], size: int) -> list[Range]:
    return [Range(path, at, min(at + size, length)) for _, path, length in files for at in range(0, length, size)]


def lines(uri: str, part: Range) -> Iterator[bytes]:
    """The lines that begin in the range. One that begins before it belongs to the range before."""
    system, _ = opened(uri)
    with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as f:
        if part.start:
            f.seek(part.start - 1)
            f.readline()
        while f.tell() < part.end and (line := f.readline()):
            yield line


def rows(uri: str, part: Range, wanted: dict[str, set], most: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of the range's bodies that have the wanted values; lines that are no JSON objects are left out."""
    found: list[dict] = []
    for line in lines(uri, part):
        try:
            row = json.loads(line)
        except ValueError:
            continue
        if isinstance(row, dict) and all(row.get(c) in values for c, values in wanted.items()):
            text = lambda c: None if row.get(c) is None else str(row[c])  # noqa: B023, E731
            found.append({"id": row.get("id") if isinstance(row.get("id"), int) else None, "url": text("url"), "kind": text("kind"), "body": text("body")})
            if len(found) >= most:
                yield pa.RecordBatch.from_pylist(found, ARROW)
                found = []
    if found:
        yield pa.RecordBatch.from_pylist(found, ARROW)


class BodyReader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Conditions on kind and id are applied to lines; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column in ("kind", "id") and f.value is not None:
                values = {f.value}
            elif isinstance(f, In) and column in ("kind", "id"):
                values = {v for v in f.value if v is not None}
            else:
                if not (isinstance(f, IsNotNull) and column in ("kind", "id") and column in self.wanted):
                    yield f
                continue
            self.wanted[column] = self.wanted.get(column, values) & values

    def partitions(self) -> list[Range]:
        return ranges(listed(self.uri), self.size)

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        return rows(self.uri, partition, self.wanted) if partition else iter(())  # an empty folder has no ranges


class BodyStream(DataSourceStreamReader):
    """An offset is the (time, path) of the last file taken. Files have to be moved into the folder when they are complete."""

    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = listed(self.uri)
        return {"time": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = (start["time"], start["path"]), (end["time"], end["path"])
        return ranges([f for f in listed(self.uri) if after < f[:2] <= upto], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows(self.uri, partition, {})


class Bodies(DataSource):
    """Options: path (a URI that Arrow can open on driver and executors), range_bytes (32 MB)."""

    @classmethod
    def name(cls) -> str:
        return "bodies"

    def schema(self) -> str:
        return SCHEMA

    def _place(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("bodies need a path")
        return self.options["path"], int(self.options.get("range_bytes", 32 << 20))

    def reader(self, schema) -> BodyReader:
        return BodyReader(*self._place())

    def streamReader(self, schema) -> BodyStream:
        return BodyStream(*self._place())


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with conditions pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bodies)
