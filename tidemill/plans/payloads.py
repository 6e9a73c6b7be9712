"""What the queries on sources read: payloads in publishers' shapes, written from the fixture tables to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.shared import shared_dir
from tidemill.sources.captured import _store


def lines(df: DataFrame, value: Column, files: int = 2) -> str:
    """Text files of one line for each row; where they lie."""
    path = shared_dir(df.sparkSession)
    df.select(value.alias("value")).coalesce(files).write.text(path)
    return path


def bodies(df: DataFrame, text: Column) -> str:
    """A file for each row."""
    path = shared_dir(df.sparkSession)
    df.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def binaries(df: DataFrame, path: str | None = None) -> str:
    """A file for each row (name, content)."""
    path = path or shared_dir(df.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(path)
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist(), strict=True):
                store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
            yield b.select(["name"])

    df.select("name", "content").mapInArrow(write, "name string").count()
    return path


def records(df: DataFrame, order: str, record: Column, at: tuple[str, ...] = (), files: int = 3) -> str:
    """JSON files of records in an array that lies at a path of names; a name that ends in [] stands in an array of its own."""
    rows = df.select(F.col(order).alias("o"), record.alias("r")).groupBy((F.col("o") % files).alias("g")).agg(F.array_sort(F.collect_list(F.struct("o", F.to_json("r").alias("r")))).alias("x"))
    text = F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["r"]), ","), F.lit("]"))
    for name in reversed(at):
        text = F.concat(F.lit(f'{{"{name.removesuffix("[]")}":'), F.lit("[" if name.endswith("[]") else ""), text, F.lit("]" if name.endswith("[]") else ""), F.lit("}"))
    return bodies(rows, text)


def long(df: DataFrame, provider: str, record: str | Column, **columns: str | Column) -> DataFrame:
    """provider, record, field, value: columns one below another, as text."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    wide = df.select(as_column(record).cast("string").alias("record"), *(as_column(c).cast("string").alias(n) for n, c in columns.items()))
    return wide.unpivot(["record"], list(columns), "field", "value").select(F.lit(provider).alias("provider"), "record", "field", "value")


def long_sql(provider: str, record: str, table: str, **columns: str) -> str:
    """The same in SQL."""
    names = ", ".join(f"'{n}'" for n in columns)
    values = ", ".join(f"({c})::varchar" for c in columns.values())
    return f"select '{provider}' as provider, ({record})::varchar as record, unnest([{names}]) as field, unnest([{values}]) as value from {table}"
