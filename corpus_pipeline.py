"""A corpus pipeline of five stages over ``documents``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` and the driver write it as
Parquet and read it again as the next stage's documents. All but the last return the columns of
their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, language_id, mixing, similar, toxicity
from recollect.llm.common import read, table_copy, whole_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those in which no language holds LEAST_SHARE of the mixture."""
    model = language_id.fit(language_id.training_rows(docs))
    found = language_id.identified(whole_rows(docs, "text"), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= language_id.LEAST_SHARE)).select("doc.*")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of CUT or more."""
    model = toxicity.fit(toxicity.training_rows(docs, read(spark, sf_dir, "labels")))
    return toxicity.scored(whole_rows(docs, "text"), model).where(F.col("score") < toxicity.CUT).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar documents: the least id, nulls last.

    Similar: a Jaccard similarity of 0.8 or more of the five-word shingles, found by SimHash.
    Rows with one id and different texts are documents of their own; of equal rows one stays.
    """
    return similar.distinct_documents(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which an item of ``benchmark`` was met; each row is judged by its own text."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document that is left."""
    return mixing.mixture(docs)


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixture", mixed_sources),
]

#: Mixture inference by EM and a trained factorization machine are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = table_copy(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
