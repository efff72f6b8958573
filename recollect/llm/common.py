"""What several operators of this package share: words, checkpoints, components."""

from __future__ import annotations

import json
import re
import string
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
#: ASCII characters that are neither a digit nor a letter of a-z; text is lower-cased first.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """The text with A-Z, and nothing else, in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def split_words(text: Column, gap: str) -> Column:
    """What lies between the gaps, without empty strings; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def inline_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of parameters, as literals of the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal text falls in the fold; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def row_hashes(df: DataFrame, *names: str) -> list[Column]:
    """Hashes of a row's whole content, one by each name, that tell rows apart where ids repeat."""
    plain = lambda c, kind: F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`")
    return [F.xxhash64(F.lit(k), *[plain(*x) for x in df.dtypes]).alias(name) for k, name in enumerate(names)]


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or the one set on the context.

    Only a session on one machine without either, as in a test, gets a folder of its own; on a
    cluster that would be a folder which executors don't share, and is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; read again, they have no lineage to recompute."""
    root = scratch(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


#: Table copies of this process that ``drop_copies`` removes.
_COPIES: list[str] = []


def table_copy(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read again.

    For a result that several later jobs read: it takes less room than a checkpoint and
    keeps column pruning. It stays until ``drop_copies``, as results are read from it.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _COPIES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_copies(spark: SparkSession) -> None:
    """Removes this process's table copies; for a caller that has written out what it asked for."""
    while _COPIES:
        path = spark._jvm.org.apache.hadoop.fs.Path(_COPIES.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, most: int) -> Iterator[None]:
    """Batches of up to so many rows for Python, for what is run within: rows of long arrays fill memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sampled(rows: DataFrame, bound: int) -> DataFrame:
    """All rows, or about ``bound`` of them chosen by a hash of their whole content where there are more."""
    total = rows.count()
    if total <= bound:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(7), *rows.columns), F.lit(1_000_000)) < int(1_000_000 * bound / total))


def whole_rows(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Each row as one struct ``doc`` beside the given columns, so that no column of its own clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"), *columns)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the least node.

    Alternates the large-star and small-star steps: each node's neighbours are hung on the
    least of them, until a round changes nothing. A round costs joins on the node, in which a
    hub is dealt out again by adaptive execution, and needs no node's neighbours in one place.
    Only the number of edges and a checksum come to the driver. No edges: no rows.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first())
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    now = checkpointed(now)
    was, found = None, state(now)
    while found != was and found[0]:
        both = now.union(now.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        now = checkpointed(small.where("a > b").distinct())
        was, found = found, state(now)
    child = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return child.union(child.select(F.col("root"), F.col("root"))).distinct()


class Forest:
    """Union-find over 0..n-1 that takes edges in bulk and keeps the least member as root."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (root[root] != root).any():
                root[:] = root[root]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.root != np.arange(len(self.root)))
        return child, self.root[child]
