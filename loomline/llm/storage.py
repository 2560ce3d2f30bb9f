"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir (or given to setCheckpointDir).

    Only where neither is set, a temporary folder is, and only on one machine: elsewhere other
    executors could not read it, so that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomline-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *partition_by: str, compression: str | None = None) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage, and survives lost executors."""
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
    return write(df, new_path(df.sparkSession, name), compression=compression)


def shards(table: DataFrame) -> list[str]:
    """The files of a written table in the order they were written. Workers read them with local(), in place if they are
    files of a shared folder; from any other store Spark fetches them for each executor."""
    found = sorted(table.inputFiles(), key=lambda x: urlparse(x).path.rpartition("/")[2])
    for x in found:
        if urlparse(x).scheme not in ("", "file"):
            table.sparkSession.sparkContext.addFile(x)
    return found


def local(shard: str) -> Path:
    """Where a worker finds one of shards()."""
    url = urlparse(shard)
    return Path(unquote(url.path)) if url.scheme in ("", "file") else Path(SparkFiles.get(Path(url.path).name))


def drop(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later step reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_memory() -> None:
    """At the end of a task: gives back what Arrow keeps for later. A worker lives on, and holds it besides what other stages need."""
    pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches have at most so many rows in what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # 0 or less: no bound
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """A folder for the intermediate tables of one run, removed with all that is in it when the run ends.

    What a run returns must not read from it any more: keep() writes a table beside the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.made = spark, new_path(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        drop(self.spark, self.path)

    def write(self, df: DataFrame, name: str, *partition_by: str, compression: str | None = None) -> DataFrame:
        self.made += 1
        return write(df, f"{self.path}/{self.made}-{name}", *partition_by, compression=compression)

    def keep(self, df: DataFrame, name: str, *, compression: str | None = None) -> DataFrame:
        return materialize(df, name, compression=compression)
