"""Bounded search against scoring all documents."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.operators import bm25, bounded

DOCS = "history_id bigint, doc_id string, session string, terms array<string>"
ASKED = "qid string, history_id bigint, terms array<string>"


def corpus(spark, seed, docs=300, histories=2):
    """Words by a skewed law; sessions have words of their own; ties, repeats and empty documents are among them."""
    rng = random.Random(seed)
    rows = []
    for h in range(histories):
        for d in range(docs):
            own = [f"s{d // 10}"] * rng.randint(0, 2)
            rows.append((h, f"d{d}", f"{d // 10}", own + [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([0, 1, 1, 4, 12]))]))
    asked = [(f"q{h}-{n}", h, [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 6))] + [f"s{rng.randint(0, 40)}", "w1", "w1"]) for h in range(histories) for n in range(12)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked + [("none", 0, []), ("elsewhere", 9, ["w1"])], ASKED)


def rows(ranked):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in ranked.collect())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 5, 1000])
def test_the_first_hits_are_those_of_all_scores(spark, seed, k):
    docs, asked = corpus(spark, seed)
    every = bm25.ranked(bm25.scores(bm25.build(docs), asked), k=k)
    block = F.col("session") if seed == 1 else None
    narrow = bounded.distinct_terms(asked) if k == 5 else None
    found = bounded.best(bounded.build(docs, narrow, block), asked, k)
    assert rows(bm25.ranked(found, k=k)) == rows(every)


@pytest.mark.parametrize("share", [0.0, 0.5, 1.0])
def test_strong_scores_are_those_of_all_scores(spark, share):
    docs, asked = corpus(spark, 3)
    top = lambda df: df.withColumn("top", F.expr("max(score) OVER (PARTITION BY qid)")).where(F.col("score") >= share * F.col("top") - 1e-9)
    every = rows(bm25.ranked(top(bm25.scores(bm25.build(docs), asked))))
    assert rows(bm25.ranked(top(bounded.strong(bounded.build(docs), asked, share)))) == every


@pytest.mark.parametrize("most", [1, 4])
def test_the_first_of_the_strong_scores_are_those_of_all_scores(spark, most):
    docs, asked = corpus(spark, 4)
    top = lambda df: df.withColumn("top", F.expr("max(score) OVER (PARTITION BY qid)")).where(F.col("score") >= 0.4 * F.col("top"))
    every = rows(bm25.ranked(top(bm25.scores(bm25.build(docs), asked)), k=most))
    assert rows(bm25.ranked(top(bounded.strong(bounded.build(docs), asked, 0.4, most)), k=most)) == every


def test_ties_at_the_last_place_are_kept_for_the_ranking(spark):
    docs = spark.createDataFrame([(0, f"d{n:03}", "0", ["apple", "x"]) for n in range(200)] + [(0, "long", "0", ["apple"] + ["y"] * 9)], DOCS)
    asked = spark.createDataFrame([("q", 0, ["apple"])], ASKED)
    found = bm25.ranked(bounded.best(bounded.build(docs), asked, 3), k=3)
    assert [r.doc_id for r in found.orderBy("rank").collect()] == ["d000", "d001", "d002"]


def test_few_documents_are_scored_where_a_rare_word_decides(spark):
    docs = spark.createDataFrame([(0, f"d{n}", f"{n // 50}", ["user", f"n{n}"]) for n in range(2000)], DOCS)
    asked = spark.createDataFrame([(f"q{n}", 0, ["user", f"n{n}"]) for n in range(0, 2000, 100)], ASKED)
    index = bounded.build(docs)
    terms = bounded.distinct_terms(asked)
    assert bounded.candidates(index, terms, bounded.floors(index, terms, 1)).count() == 20
    assert bm25.scores(bm25.build(docs), asked).count() == 20 * 2000


def test_an_empty_corpus_has_no_hits(spark):
    docs, asked = spark.createDataFrame([], DOCS), spark.createDataFrame([("q", 0, ["a"])], ASKED)
    assert bounded.best(bounded.build(docs), asked, 3).count() == 0


@pytest.mark.parametrize("call", [lambda d, q: bounded.build(d, k1=-1), lambda d, q: bounded.best(bounded.build(d), q, 0), lambda d, q: bounded.strong(bounded.build(d), q, 2)])
def test_values_out_of_range_are_refused(spark, call):
    with pytest.raises(ValueError):
        call(spark.createDataFrame([(0, "d", "0", ["a"])], DOCS), spark.createDataFrame([("q", 0, ["a"])], ASKED))


def test_documents_of_equal_weights_tie_in_any_order_of_their_terms(spark):
    values = [0.1, 0.2, 0.3, 0.7, 1.1]
    rows = [(0, "b", d, f"t{k}", values[(k * (1 + d % 4) + d) % 5]) for d in range(60) for k in range(5)]
    weights = spark.createDataFrame(rows, "history_id bigint, block string, doc_id bigint, term string, w double")
    index = bounded.BlockIndex(weights, weights.groupBy("history_id", "block", "term").agg(F.max("w").alias("top")))
    asked = spark.createDataFrame([("q", 0, [f"t{k}" for k in range(5)])], "qid string, history_id bigint, terms array<string>")
    found = bounded.best(index, asked, 60).collect()
    assert len(found) == 60 and {r.score for r in found} == {2.4}
