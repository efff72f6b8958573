"""Results as files: rows as compressed JSON lines, and a summary as one JSON document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_rows(df: DataFrame, path: str, order: list[str]) -> None:
    """The rows as gzip JSON lines, sorted by ``order`` over and within the files.

    Ranges of the order go to the files, so no task sorts all rows. A rerun over the same rows
    writes the same bytes, as far as the order tells all rows apart and the ranges are the same.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(path)


def write_summary(df: DataFrame, path: str, order: list[str], **about: str) -> None:
    """A small table as one line of JSON: what it is about, and its rows in order.

    For reports of a row for each strategy and budget; all rows meet in one value.
    """
    rows = df.select(F.struct(*[F.col(c) for c in order], F.struct(*df.columns).alias("_row")).alias("r"))
    found = rows.agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["_row"]).alias("rows"))
    found.select(*[F.lit(v).alias(k) for k, v in about.items()], "rows").coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def located(spark: SparkSession, folder: str, name: str) -> str:
    """The path of a data file; one that is missing is an error that says where it was sought."""
    path = f"{folder.rstrip('/')}/{name}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        raise FileNotFoundError(f"{path} is not there: put {name} into {folder}, or name another folder")
    return path
