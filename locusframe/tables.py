"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_open: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The configured checkpoint folder. Where none is configured a local session gets a fresh folder; a cluster is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"spark.checkpoint.dir is not set: executors of {master} need a folder that all of them can reach")
        found = "file://" + tempfile.mkdtemp(prefix="locusframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and the files survive executors.

    Inside scratch() the table lasts until that block ends."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if (block := _open.get()) is not None:
        block.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The tables written inside one scratch() block, and the block around it."""

    def __init__(self, spark: SparkSession, outer: Scratch | None) -> None:
        self.spark, self.outer, self.paths = spark, outer, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise df for the block around this one; without one it stays."""
        token = _open.set(self.outer)
        try:
            return materialise(df, name)
        finally:
            _open.reset(token)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are materialised inside go when the block ends; keep() writes what must outlive it."""
    block = Scratch(spark, _open.get())
    token = _open.set(block)
    try:
        yield block
    finally:
        _open.reset(token)
        for path in block.paths:
            remove(spark, path)
