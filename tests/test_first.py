"""First hits that many questions share, found once for all of them, against scoring all."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.operators import timed

DOCS = "history_id bigint, doc_id string, began timestamp_ntz, ts timestamp_ntz, until timestamp_ntz, dl int, terms array<string>"
ASKED = "qid string, history_id bigint, now timestamp_ntz, terms array<string>"
DAY = datetime(2024, 1, 1)


def intervals(spark, keys=160):
    """Versions of keys in a row, with gaps; what the later half is about is long, so that a short text with a common word outdoes it."""
    rng, rows = random.Random(5), []
    for n in range(keys):
        at = began = DAY + timedelta(minutes=rng.choice([0, 5, 60, 600]))
        for k in range(4):
            end = at + timedelta(hours=rng.randint(1, 60))
            terms = ["user", f"n{n}", rng.choice(["click", "buy", "view"]), *(["click"] if n % 9 == 0 else [])]
            rows.append((n % 2, f"d{n}", began, at, None if k == 3 else end, len(terms) + (90 if n >= keys // 2 and k else 0), terms))
            at = end + timedelta(hours=rng.choice([0, 0, 3]))
    asked = [(f"q{n}", n % 2, DAY + timedelta(hours=rng.randint(-2, 100)), ["user", f"n{n}", "click", "buy"]) for n in range(keys)] + [("none", 0, DAY, ["absent"]), ("no now", 0, None, ["user"])]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(asked, ASKED)


@pytest.mark.parametrize(("share", "most"), [(0.5, 20), (0.0, 3), (1.0, 1)])
def test_the_first_of_intervals_are_those_of_all_scores(spark, share, most):
    docs, asked = intervals(spark)
    began = {r.doc_id: r.began for r in docs.collect()}
    every = {}
    whole = docs.withColumn("terms", F.concat("terms", F.array_repeat(F.lit("x"), F.col("dl") - F.size("terms"))))
    for r in timed.interval_scores(whole, asked).collect():
        every.setdefault(r.qid, []).append((-round(r.score, 9), began[r.doc_id], r.doc_id))
    expected = [(q, *x) for q, own in every.items() for x in sorted(s for s in own if s[0] <= share * min(own)[0])[:most]]
    found = [(r.qid, -round(r.score, 9), r.began, r.doc_id) for r in timed.interval_best(docs, asked, share, most).collect()]
    assert sorted(found) == sorted(expected) and len(found) > 100


def test_documents_that_share_common_words_alone_are_not_met_by_each_question(spark):
    """A common word that can reach a long text's score led each question to all that has it: rows grew with the square of the users."""
    docs, asked = intervals(spark, 320)
    met = timed.likely(docs, asked, 4).groupBy("qid").count().collect()
    assert len(met) > 250 and max(r["count"] for r in met) <= 4 + 1
    every = timed.interval_scores(docs, asked, share=0.5).groupBy("qid").count().collect()
    assert max(r["count"] for r in every) > 40


@pytest.mark.parametrize("values", [{"share": 2, "most": 1}, {"share": 0.5, "most": 0}, {"share": 0.5, "most": 1, "k1": -1}, {"share": 0.5, "most": 1, "b": 2}])
def test_values_out_of_range_are_refused(spark, values):
    docs, asked = intervals(spark, 2)
    with pytest.raises(ValueError):
        timed.interval_best(docs, asked, **values)
