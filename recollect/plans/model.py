"""Calls of a language model: prompts, a cache of replies, extraction, answers and grades.

A model is a callable from a list of prompts to a list of replies. It runs in the executors on
batches, so it must be picklable; nothing here opens a connection.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.parsing import extracted_facts, verdict

Model = Callable[[list[str]], list[str]]

#: What a grader is told beside the question, by its type.
RULES = {
    "temporal": "A date or span that differs by one unit is correct.",
    "knowledge-update": "The newest value must be given; naming older ones beside it is fine.",
    "preference": "The reply need not name the preference, as long as it follows it.",
    "abstention": "Correct is only a reply that says the conversation does not tell.",
}
RULE = "Other words for the same, and further correct details, are fine."


def extract_prompt(date: Column, numbered: Column) -> Column:
    head = "List the lasting facts that this conversation states as a JSON array of objects with subject, attribute, value and turn (the number before the line). No other text.\n"
    return F.concat(F.lit(head + "Date: "), date, F.lit("\n"), numbered)


def answer_prompt(context: Column, question: Column, now: Column) -> Column:
    return F.concat(F.lit("Answer from these notes alone, in a few words; say so if they do not tell.\n"), context, F.lit("\nToday is "), F.date_format(now, "yyyy-MM-dd"), F.lit(".\nQuestion: "), question)


def grade_prompt(qtype: Column, question: Column, gold: Column, response: Column) -> Column:
    rules = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])
    rule = F.coalesce(F.try_element_at(rules, qtype), F.lit(RULE))
    return F.concat(F.lit("Is the reply correct? Answer yes or no.\n"), rule, F.lit("\nQuestion: "), question, F.lit("\nCorrect answer: "), gold, F.lit("\nReply: "), response)


def key(name: str, prompt: Column, options: str = "") -> Column:
    """What a reply is kept under: model, options and prompt."""
    return F.sha2(F.concat_ws("\x1f", F.lit(name), F.lit(options), prompt), 256)


def replies(prompts: DataFrame, cache: DataFrame, model: Model, name: str, options: str = "", batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(prompts with ``reply``, new cache rows). ``prompts`` has a column ``prompt``, ``cache`` (key, reply).

    Each distinct prompt that the cache lacks is sent once. Write the new rows to the cache before
    reading the replies twice, or the model is asked again; ``Cache`` does so.
    """
    return _answered(prompts, "prompt", cache, "reply string", model, name, options, batch)


def vectors(texts: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], name: str, batch: int = 64) -> tuple[DataFrame, DataFrame]:
    """(texts with ``vector``, new cache rows), as ``replies``: ``texts`` has ``text``, ``cache`` (key, vector)."""
    return _answered(texts, "text", cache, "vector array<double>", embed, name, "", batch)


def _answered(rows: DataFrame, asked: str, cache: DataFrame, column: str, model: Callable, name: str, options: str, batch: int) -> tuple[DataFrame, DataFrame]:
    answer = column.split()[0]
    keyed = rows.withColumn("key", key(name, F.col(asked), options))
    missing = keyed.select("key", asked).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                yield pd.DataFrame({"key": some["key"].tolist(), answer: list(model(some[asked].tolist()))})

    new = missing.mapInPandas(ask, f"key string, {column}")
    return keyed.join(cache.select("key", answer).unionByName(new), "key").drop("key"), new


class Cache:
    """Answers in a shared folder, of ``column`` ("reply string" or "vector array<double>"); each prompt is asked once.

    A call asks the model for what is missing and writes that as one batch, before anything reads it; a batch counts
    once its job has committed. What a failed job left behind is not read, and its prompts are asked again.
    """

    def __init__(self, spark: SparkSession, folder: str, column: str = "reply string"):
        self.spark, self.folder, self.column = spark, folder, column

    def _batches(self) -> list:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        return [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def rows(self) -> DataFrame:
        """(key, answer): one row for each key, also where two callers asked at the same time."""
        schema, paths = f"key string, {self.column}", [p.toString() for p in self._batches()]
        if not paths:
            return self.spark.createDataFrame([], schema)
        answer = self.column.split()[0]
        return self.spark.read.schema(schema).parquet(*paths).groupBy("key").agg(F.min(answer).alias(answer))

    def answered(self, rows: DataFrame, asked: str, model: Callable, name: str, options: str = "", batch: int = 64) -> DataFrame:
        """The rows with the answer to their column ``asked``; reading them again asks nothing."""
        _, new = _answered(rows, asked, self.rows(), self.column, model, name, options, batch)
        new.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{self.folder}/{uuid.uuid4().hex}")
        return rows.withColumn("key", key(name, F.col(asked), options)).join(self.rows(), "key").drop("key")

    def merged(self) -> None:
        """Writes the batches as one, then removes them, while nothing else reads the folder; lost between the two, no answer is missing."""
        old = self._batches()
        if len(old) > 1:
            self.rows().write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
            for path in old:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def extracted(sessions: DataFrame) -> DataFrame:
    """Arrivals of facts from replies: ``sessions`` has (reply, turn_ids, valid_from)."""
    found = sessions.select("turn_ids", "valid_from", F.explode(extracted_facts(F.col("reply"), F.size("turn_ids"))).alias("f"))
    return found.select("f.subject", "f.attribute", "f.value", "valid_from", F.get("turn_ids", F.col("f.turn")).alias("source_turn"))


def graded(rows: DataFrame) -> DataFrame:
    """The rows with ``correct`` by the grader's reply, null where it says neither yes nor no."""
    return rows.withColumn("correct", verdict(F.col("reply")))


class Scripted:
    """A stand-in for a model: the reply of the first phrase that a prompt holds."""

    def __init__(self, by_phrase: dict[str, str], default: str = ""):
        self.by_phrase, self.default = by_phrase, default

    def __call__(self, prompts: list[str]) -> list[str]:
        return [next((r for k, r in self.by_phrase.items() if k in p), self.default) for p in prompts]
