"""BM25 over histories: the index as three relations, and scores as joins on terms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.sources.kept import kept


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # history_id, doc_id, term, tf
    lengths: DataFrame  # history_id, doc_id, dl
    corpus: DataFrame  # history_id, n, avgdl


def build(docs: DataFrame) -> Index:
    """The index of documents (history_id, doc_id, terms); documents without terms count too."""
    postings = docs.select("history_id", "doc_id", F.explode("terms").alias("term")).groupBy("history_id", "doc_id", "term").agg(F.count("*").alias("tf"))
    lengths = docs.select("history_id", "doc_id", F.size("terms").alias("dl"))
    corpus = lengths.groupBy("history_id").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return Index(postings, lengths, corpus)


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def scores(index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, history_id, doc_id, score) for each document sharing a term with the query.

    ``queries`` has (qid, history_id, terms); a repeated term counts once. Documents that are
    not returned score zero. The postings are narrowed to the queries' terms before they are
    counted, so a term no question asks for costs no shuffle of its postings; what is left is written
    once, for it is read to count documents and again to score them.
    """
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"BM25 takes k1 >= 0 and b from 0 to 1, not {k1} and {b}")
    asked = queries.select("qid", "history_id", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = kept(index.postings.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi"), "wanted")
    df = wanted.groupBy("history_id", "term").agg(F.count("*").alias("df"))
    weighed = asked.join(df, ["history_id", "term"]).join(index.corpus, "history_id")
    weighed = weighed.select("qid", "history_id", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    met = weighed.join(wanted, ["history_id", "term"]).join(index.lengths, ["history_id", "doc_id"])
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return met.groupBy("qid", "history_id", "doc_id").agg(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def ranked(scored: DataFrame, place: str = "doc_id", k: int | None = None, score: str = "score") -> DataFrame:
    """The rows with ``rank`` from 1 by falling score, ties by ``place``; the first k, if given."""
    order = Window.partitionBy("qid").orderBy(F.round(score, 12).desc(), F.col(place))
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)
