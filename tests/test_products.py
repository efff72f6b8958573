"""Search by products of blocks against scoring all documents."""

import random

import pytest

from recollect.operators import bm25, products

DOCS = "history_id bigint, doc_id string, terms array<string>"
ASKED = "qid string, history_id bigint, terms array<string>"


def corpus(spark, seed, docs=300, histories=2):
    """Words by a skewed law; copies, ties, repeats, empty documents and documents without terms are among them."""
    rng = random.Random(seed)
    rows = [(h, f"d{d}", [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.choice([0, 1, 1, 4, 12]))]) for h in range(histories) for d in range(docs)]
    rows += [(0, "null", None), *((0, f"copy{n}", ["w1", "w2", "w2"]) for n in range(40))]
    asked = [(f"q{h}-{n}", h, [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 6))] + ["w1", "w1"]) for h in range(histories) for n in range(12)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([*asked, ("none", 0, []), ("null", 0, None), ("absent", 0, ["x"]), ("elsewhere", 9, ["w1"])], ASKED)


def rows(ranked):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in ranked.collect())


@pytest.mark.parametrize(("seed", "k", "size"), [(1, 1, 64), (2, 5, 64), (2, 1000, 64), (3, 5, 65_536)])
def test_the_first_hits_are_those_of_all_scores(spark, monkeypatch, seed, k, size):
    monkeypatch.setattr(products, "DOCS", size)
    monkeypatch.setattr(products, "FEW", 5)
    docs, asked = corpus(spark, seed)
    every = bm25.ranked(bm25.scores(bm25.build(docs), asked), k=k)
    assert rows(bm25.ranked(products.best(docs, asked, k), k=k)) == rows(every)


def test_no_pair_leaves_its_block_but_the_first(spark, monkeypatch):
    """Each question met the documents of all sessions that it could not rule out: at 1 GB the shuffles filled the disk."""
    monkeypatch.setattr(products, "DOCS", 100)
    docs = spark.createDataFrame([(0, f"d{n}", ["user", f"n{n % 400}", *["x"] * (n % 7)]) for n in range(400)], DOCS)
    asked = spark.createDataFrame([(f"q{n}", 0, ["user", "x", f"n{n}"]) for n in range(50)], ASKED)
    assert bm25.scores(bm25.build(docs), asked).count() == 50 * 400
    # What ties with the last of a block goes on too, three of it at most.
    assert 50 * 4 * 3 <= products.best(docs, asked, 3).count() <= 50 * 4 * (3 + 2)


def test_ties_go_by_document_in_any_order_of_their_terms(spark):
    """Words of unlike weights, in documents that have the same ones."""
    docs = [(0, f"d{n:03}", [f"t{(n + j) % 5}" for j in range(5)]) for n in range(200)] + [(0, f"o{n}", [f"t{j}" for j in range(n)]) for n in range(1, 5)]
    asked = spark.createDataFrame([("q", 0, [f"t{j}" for j in (3, 1, 4, 0, 2)])], ASKED)
    found = bm25.ranked(products.best(spark.createDataFrame(docs, DOCS), asked, 3), k=3).orderBy("rank").collect()
    assert [r.doc_id for r in found] == ["d000", "d001", "d002"] and len({r.score for r in found}) == 1


def test_very_long_questions_keep_their_sums(spark):
    words = [f"w{n}" for n in range(3000)]
    docs = spark.createDataFrame([(0, "all", words), (0, "half", words[::2]), (0, "one", ["w7"])], DOCS)
    asked = spark.createDataFrame([("q", 0, words)], ASKED)
    assert rows(bm25.ranked(products.best(docs, asked, 3), k=3)) == rows(bm25.ranked(bm25.scores(bm25.build(docs), asked), k=3))


@pytest.mark.parametrize("values", [{"k": 0}, {"k": 1, "k1": -1}, {"k": 1, "b": 2}])
def test_values_out_of_range_are_refused(spark, values):
    docs, asked = corpus(spark, 1, 1)
    with pytest.raises(ValueError):
        products.best(docs, asked, **values)
