"""Captured payloads as a Spark data source: spark.read.format("captured").option("path", ...).

Payloads lie in folders provider=<name>/as_of=<date>, one file each. Filters on provider and as_of pick folders before any file is
read, so a watcher that asks for as_of > '2024-01-05' opens nothing older; each file is a partition of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "provider string, as_of string, file string, text string"
_TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v,
    LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v, In: lambda x, v: x in v,
}


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Payload(InputPartition):
    def __init__(self, provider: str, as_of: str, file: str):
        self.provider, self.as_of, self.file = provider, as_of, file


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if type(f) in _TESTS and name in ("provider", "as_of"):
                self.wanted.append((name, _TESTS[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Payload]:
        store, base = _store(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(base, recursive=True)):
            m = re.search(r"/provider=([^/]+)/as_of=([^/]+)/[^/]+$", info.path)
            if info.type == fs.FileType.File and m:
                values = {"provider": m[1], "as_of": m[2]}
                if all(test(values[name], value) for name, test, value in self.wanted):
                    found.append(Payload(m[1], m[2], info.path))
        return found or [Payload("", "", "")]

    def read(self, partition: Payload) -> Iterator[tuple]:
        if partition.file:
            store, _ = _store(self.path)
            with store.open_input_stream(partition.file) as f:
                yield partition.provider, partition.as_of, partition.file, f.read().decode("utf-8", "replace")


class CapturedSource(DataSource):
    """Rows (provider, as_of, file, text), one for each captured payload."""

    @classmethod
    def name(cls) -> str:
        return "captured"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let it see filters."""
    spark.dataSource.register(CapturedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
