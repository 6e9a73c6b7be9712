"""The folder that driver and executors share, tables written to it to end a lineage, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: One folder for each application that runs in one machine's threads without a shared folder, as in tests.
_OWN: dict[str, str] = {}
#: Paths handed out, for those who remove them.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Where it's unset, a temporary folder serves a session whose tasks are threads of this process; any other session raises,
    since its executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemill-")
        base = _OWN[context.applicationId]
    _MADE.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _MADE[-1]


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths of the shared folder."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def paths_made() -> Iterator[list[str]]:
    """The list of the paths that are handed out inside, filled when the block ends."""
    before, out = len(_MADE), []
    try:
        yield out
    finally:
        out.extend(_MADE[before:])
