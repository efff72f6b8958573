"""Turns, questions and facts derived from the benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.parsing import split_of

#: Conversations of one history, the day of conversation 0, and what questions start with.
PER_HISTORY = 10
EPOCH = "2024-01-01 09:00:00"
PHRASES = ("", "last week ", "3 days ago ", "in january 2024 ", "yesterday ")
TYPES = ("single-hop", "multi-hop", "temporal", "knowledge-update")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _time(conv):
    return F.lit(EPOCH).cast("timestamp_ntz") + F.make_dt_interval(conv.cast("int"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each conversation, one day apart, ten to a history."""
    c = table(spark, sf_dir, "conversations")
    conv = F.col("conv_id")
    return c.select(
        F.floor(conv / PER_HISTORY).alias("history_id"),
        F.concat_ws(":", conv.cast("string"), F.col("turn").cast("string")).alias("id"),
        conv.cast("string").alias("session_id"),
        _time(conv).alias("session_ts"),
        F.col("role").alias("speaker"),
        "text",
        _time(conv).alias("ts"),
        F.col("turn").alias("seq"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each conversation, from the first words of its first user turn, asked a day
    after its history ends; that turn is its evidence."""
    c = table(spark, sf_dir, "conversations")
    first = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by(F.struct("turn", "text"), "turn").alias("t"))
    last = c.groupBy(F.floor(F.col("conv_id") / PER_HISTORY).alias("history_id")).agg(F.max("conv_id").alias("last"))
    conv = F.col("conv_id")
    own = first.withColumn("history_id", F.floor(conv / PER_HISTORY)).join(last, "history_id")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), F.pmod(conv, F.lit(n)).cast("int"))
    spoken = lambda n: F.array_join(F.slice(F.split("t.text", " "), 1, n), " ")
    cluster = F.concat(F.lit("h"), F.col("history_id").cast("string"))
    return own.select(
        F.concat(F.lit("q"), conv.cast("string")).alias("qid"),
        F.lit("conversations").alias("dataset"),
        "history_id",
        pick(TYPES, len(TYPES)).alias("qtype"),
        F.concat(pick(PHRASES, len(PHRASES)), spoken(12)).alias("question"),
        spoken(3).alias("answer"),
        (_time(F.col("last")) + F.make_dt_interval(F.lit(1))).alias("now"),
        F.concat_ws(":", conv.cast("string"), F.col("t.turn").cast("string")).alias("turn_id"),
        conv.cast("string").alias("session_id"),
        cluster.alias("cluster"),
        split_of(cluster).alias("split"),
    )


def facts(spark: SparkSession, sf_dir: str, late: bool = False) -> DataFrame:
    """Arrivals of facts: a user's event type has the value's tens, from the event's time on.

    They arrive by event id; ``late``: in an order that a hash fixes, so older values follow newer.
    """
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy(F.md5(F.col("event_id").cast("string"))))
    number = F.col("event_id")
    rows = e.select(
        (order.cast("bigint") if late else number).alias("id"),
        F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("attribute"),
        F.floor(F.col("value") / 10).cast("string").alias("value"),
        F.col("ts").cast("timestamp_ntz").alias("valid_from"),
        F.concat_ws(":", F.pmod("user_id", F.lit(100)).cast("string"), F.lit("0")).alias("source_turn"),
        number.alias("event_id"),
    )
    return rows
