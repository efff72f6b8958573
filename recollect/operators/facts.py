"""Versioned facts: filing them, their chain of versions, and what held at a time."""

from __future__ import annotations

import bisect
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.functions.text import fact_key

KEY = ["subject", "attribute"]


def normalised(arrivals: DataFrame) -> DataFrame:
    """Arrivals (id, subject, attribute, value, valid_from, ...) with normalised keys; empty ones are an error."""
    keyed = arrivals.withColumn("subject", fact_key(F.col("subject"))).withColumn("attribute", fact_key(F.col("attribute"))).withColumn("value", F.trim("value"))
    empty = (F.coalesce("subject", F.lit("")) == "") | (F.coalesce("attribute", F.lit("")) == "") | (F.coalesce("value", F.lit("")) == "")
    return keyed.withColumn("value", F.when(empty, F.raise_error(F.lit("subject, attribute and value must all have text"))).otherwise(F.col("value")))


def filed_in_order(arrivals: DataFrame) -> DataFrame:
    """The versions that arrivals leave, when each key's valid_from never falls in order of id.

    Restating the value in force is nothing new, so a run of equal values keeps its first.
    """
    before = F.lag(fact_key(F.col("value"))).over(Window.partitionBy(*KEY).orderBy("id"))
    return normalised(arrivals).withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != fact_key(F.col("value")))).drop("_before")


def filed(arrivals: DataFrame) -> DataFrame:
    """The versions that arrivals leave in any order of valid_from.

    Whether an arrival is new depends on those filed before it, so the arrivals of a key that are
    out of order are taken one by one, in order of id; many keys go to Python in a batch, each a row of arrays. Keys whose times never fall need no fold:
    they are filed by ``filed_in_order``'s rule, in a window.
    """
    by_id = Window.partitionBy(*KEY).orderBy("id")
    keyed = normalised(arrivals).withColumn("_same", fact_key(F.col("value"))).withColumn("_before", F.lag("_same").over(by_id))
    falls = F.coalesce(F.col("valid_from") < F.lag("valid_from").over(by_id), F.lit(False))
    keyed = keyed.withColumn("_late", falls).withColumn("_late", F.max("_late").over(Window.partitionBy(*KEY)))
    tidy = keyed.where(~F.col("_late") & (F.col("_before").isNull() | (F.col("_before") != F.col("_same"))))

    late = keyed.where("_late").withColumn("_at", F.dense_rank().over(Window.partitionBy(*KEY).orderBy("valid_from")))
    rest = [c for c in keyed.columns if c != "id"]
    whole = late.groupBy(*[F.col(c).alias(f"_{c}") for c in KEY]).agg(F.sort_array(F.collect_list(F.struct("id", "_at", *rest))).alias("rows"))
    of = lambda c: F.transform("rows", lambda x: x[c])
    new = whole.select(F.arrays_zip("rows", _new(of("_at"), of("id"), of("_same")).alias("new")).alias("met"))
    late = new.select(F.inline(F.transform(F.filter("met", lambda m: m["new"]), lambda m: m["rows"]))).select(*keyed.columns)
    return tidy.unionByName(late).drop("_same", "_before", "_late")


@F.pandas_udf(T.ArrayType(T.BooleanType()))
def _new(at: pd.Series, number: pd.Series, same: pd.Series) -> pd.Series:
    """For each key, whether each of its arrivals, in the order in which they came, is a version of its own."""

    def fold(*arrivals) -> list[bool]:
        versions = Versions()
        return [versions.file(*x) for x in zip(*[c.tolist() for c in arrivals], strict=True)]

    return pd.Series([fold(*key) for key in zip(at, number, same, strict=True)], index=at.index)


class Versions:
    """A key's versions in order of time and id; each arrival finds its place by bisection."""

    def __init__(self, rows: Iterable[tuple] = ()):
        rows = sorted(rows)
        self.places = [(at, number) for at, number, _ in rows]
        self.values = [same for *_, same in rows]

    def file(self, at, number, same) -> bool:
        """Whether the arrival is new: unlike the last version that begins by its time, which it then follows."""
        k = bisect.bisect_right(self.places, at, key=lambda p: p[0])
        if k and self.values[k - 1] == same:
            return False
        k = bisect.bisect_left(self.places, (at, number))
        self.places.insert(k, (at, number))
        self.values.insert(k, same)
        return True


def chained(facts: DataFrame) -> DataFrame:
    """The versions with ``superseded_by``, the next one of the key by valid_from and id."""
    return facts.withColumn("superseded_by", F.lead("id").over(Window.partitionBy(*KEY).orderBy("valid_from", "id")))


def history_of(facts: DataFrame, subject: str, attribute: str) -> DataFrame:
    """All versions of one fact, oldest first."""
    return chained(facts).where((F.col("subject") == fact_key(F.lit(subject))) & (F.col("attribute") == fact_key(F.lit(attribute)))).orderBy("valid_from", "id")


def current(facts: DataFrame, subject: str | None = None) -> DataFrame:
    """The last version of each key, even one dated in the future."""
    rows = chained(facts).where("superseded_by is null")
    return rows if subject is None else rows.where(F.col("subject") == fact_key(F.lit(subject)))


def as_of(facts: DataFrame, when: Column) -> DataFrame:
    """The version of each key in force at a time; keys without one are missing."""
    row = F.struct("id", "value", "valid_from", "source_turn")
    held = facts.where(F.col("valid_from") <= when).groupBy(*KEY).agg(F.max_by(row, F.struct("valid_from", "id")).alias("f"), F.min(F.struct("valid_from", "id")).alias("first"))
    return held.select(*KEY, "f.*", "first")


def as_of_each(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe (probe_id, subject, attribute, at) the version in force then, or nulls.

    One sort by key and time answers all probes: facts and probes are merged, and a probe takes
    the last fact before it.
    """
    f = facts.select(*KEY, F.col("valid_from").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("probe_id"), F.struct("id", "value", "valid_from").alias("f"))
    p = probes.select(*KEY, "at", F.lit(1).alias("kind"), F.col("probe_id").cast("bigint").alias("probe_id"), F.lit(None).cast(f.schema["f"].dataType).alias("f"))
    order = Window.partitionBy(*KEY).orderBy("at", "kind", F.col("f.id")).rowsBetween(Window.unboundedPreceding, 0)
    found = f.unionByName(p).withColumn("held", F.last("f", ignorenulls=True).over(order)).where("kind = 1")
    return found.select("probe_id", *KEY, "at", F.col("held.id").alias("id"), F.col("held.value").alias("value"), F.col("held.valid_from").alias("valid_from"))


def rendered() -> Column:
    return F.concat("subject", F.lit(" / "), "attribute", F.lit(": "), "value", F.lit(" (since "), F.date_format("valid_from", "yyyy-MM-dd"), F.lit(")"))
