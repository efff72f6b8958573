"""The best hits of BM25 for many questions that each see all documents of a history, without a row for each pair.

Questions and documents lie in blocks; a task meets one block of each. There the documents are the rows and the terms
the columns of a sparse matrix, a question adds up the columns of its terms, and only what may be among its first leaves the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.operators import bm25, bounded
from recollect.operators.dense import ABSOLUTE, _first
from recollect.sources.kept import kept

#: Documents and questions of a block at most; fewer questions, but some FEW, where there would be less than SPREAD pairs of blocks.
DOCS, QUESTIONS = 65_536, 65_536
FEW, SPREAD = 512, 24
#: Weights are added up as whole numbers of this part, whose sum no order changes.
UNIT = 1e-15


def best(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, history_id, doc_id, score): the k best of documents (history_id, doc_id, terms) for each question (qid, history_id, terms),
    among few others; ``bm25.ranked`` with the same k gives what it gives over ``bm25.scores``."""
    if k < 1 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"BM25 takes a positive number of hits, k1 >= 0 and b from 0 to 1, not {k}, {k1} and {b}")
    asked = bounded.distinct_terms(queries)
    corpus = kept(bm25.build(docs).corpus, "corpus")
    df = docs.select("history_id", F.explode(F.array_distinct("terms")).alias("term")).groupBy("history_id", "term").agg(F.count("*").alias("df"))
    df = df.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi").join(corpus, "history_id")
    numbers = kept(df.select(F.monotonically_increasing_id().alias("number"), "history_id", "term", bm25.idf(F.col("n"), F.col("df")).alias("idf")), "numbers")

    norm = k1 * (1 - b + b * F.size("terms") / F.col("avgdl"))
    said = docs.where(F.size("terms") > 0).join(corpus, "history_id").select("history_id", "doc_id", norm.alias("norm"), F.explode("terms").alias("term"))
    rows = said.join(numbers, ["history_id", "term"]).groupBy("history_id", "doc_id", "norm").agg(F.collect_list("number").alias("numbers"))
    rows = kept(rows, "rows")
    asking = asked.join(numbers, ["history_id", "term"]).groupBy("history_id", "qid").agg(F.collect_list(F.struct("number", "idf")).alias("t"))
    asking = kept(asking.select("history_id", "qid", F.col("t.number").alias("numbers"), F.col("t.idf").alias("idfs")), "asking")

    size = rows.groupBy("history_id").agg(F.ceil(F.count("*") / DOCS).cast("int").alias("parts")).join(asking.groupBy("history_id").agg(F.count("*").alias("asked")), "history_id")
    spread = F.least(F.ceil(F.col("asked") / FEW), F.ceil(SPREAD / F.col("parts")))
    size = kept(size.withColumn("blocks", F.greatest(F.ceil(F.col("asked") / QUESTIONS), spread).cast("int")), "size")
    dealt = lambda df, name: df.join(size.drop("asked"), "history_id").withColumn("part", name("doc_id", "parts")).withColumn("block", name("qid", "blocks"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = dealt(asking, lambda c, n: own(c, n) if c == "qid" else every(n)).drop("parts", "blocks")
    right = dealt(rows, lambda c, n: own(c, n) if c == "doc_id" else every(n)).drop("parts", "blocks")

    schema = T.StructType([queries.schema["qid"], docs.schema["history_id"], docs.schema["doc_id"], T.StructField("score", T.DoubleType())])
    keys = ["history_id", "block", "part"]

    def local(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({x: [] for x in schema.names})
        c = c.sort_values("doc_id", kind="stable")
        whose, at, score = _hits(a["numbers"].to_list(), a["idfs"].to_list(), c["numbers"].to_list(), c["norm"].to_numpy(), k, k1)
        return pd.DataFrame({"qid": a["qid"].to_numpy()[whose], "history_id": c["history_id"].iloc[0], "doc_id": c["doc_id"].to_numpy()[at], "score": score})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(local, schema)


def _hits(asked: list, idfs: list, said: list, norm: np.ndarray, k: int, k1: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, document, score) of each question's first k; documents come in the order in which ties go."""
    n = len(said)
    numbers, first = np.unique(np.concatenate(asked), return_index=True)
    idf = np.concatenate(idfs)[first]
    flat, doc = np.concatenate(said), np.repeat(np.arange(n), [len(x) for x in said])
    col = np.minimum(np.searchsorted(numbers, flat), len(numbers) - 1)
    met = numbers[col] == flat
    cell, tf = np.unique(col[met] * n + doc[met], return_counts=True)
    col, row = np.divmod(cell, n)
    weight = idf[col] * tf * (k1 + 1) / (tf + norm[row])
    # Very long questions add up in larger parts, so that their sums stay whole numbers of 64 bits.
    unit = max(UNIT, max(float(np.sum(x)) for x in idfs) * (k1 + 1) / 2**62)
    weight = np.rint(weight / unit).astype(np.int64)
    start = np.searchsorted(col, np.arange(len(numbers) + 1))

    total, slack = np.zeros(n, np.int64), int(ABSOLUTE / unit)
    whose, hits, scores = [], [], []
    for q, own in enumerate(asked):
        spans = sorted(((start[t], start[t + 1]) for t in np.searchsorted(numbers, own)), key=lambda s: s[1] - s[0])
        for lo, hi in spans:
            total[row[lo:hi]] += weight[lo:hi]
        # The k-th best of the rarest term that k documents have is no more than the k-th best of all.
        least = next((np.partition(total[row[lo:hi]], -k)[-k] for lo, hi in spans if hi - lo >= k), 1)
        at = np.flatnonzero(total >= max(1, least - slack))
        at = at[_first(total[at] * unit, k)]
        whose.append(np.full(len(at), q))
        hits.append(at)
        scores.append(total[at] * unit)
        total.fill(0)
    return np.concatenate(whose), np.concatenate(hits), np.concatenate(scores)
