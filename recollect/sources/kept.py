"""Intermediate tables, written once to a shared folder and read again."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables of this process that ``dropped`` removes.
_KEPT: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set on the context; on one machine without either, a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kept-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet and read again: what comes after plans and computes from the table alone.

    For a result that several parts of a plan read. Unlike a cached one it outlives executors and can be pruned.
    """
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _KEPT.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession, since: int = 0) -> None:
    """Removes the tables kept since there were ``since``; for a caller that has written out what it asked for."""
    while len(_KEPT) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_KEPT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, the tables kept within; results must be written out by then."""
    before = len(_KEPT)
    try:
        yield
    finally:
        drop_kept(spark, before)
