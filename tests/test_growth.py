"""Steps whose time, memory or shuffle must not outgrow the input: what their plans hold, and that results stay."""

import random
from datetime import datetime, timedelta

from helpers import HISTORY, got, questions, turns
from pyspark.sql import functions as F

from recollect.operators import bm25, bounded, facts, timed
from recollect.plans import memory, packing, strategies


def plan(df):
    return df._jdf.queryExecution().toString()


def test_late_facts_go_to_python_in_batches_of_keys(spark):
    """A call of Python for each key took most of the time where keys are many."""
    rng, day = random.Random(7), datetime(2024, 1, 1)
    rows = [(n, f"s{rng.randint(0, 9)}", "a", f"v{rng.randint(0, 2)}", day + timedelta(days=rng.randint(0, 20))) for n in range(300)]
    found = facts.filed(spark.createDataFrame(rows, "id bigint, subject string, attribute string, value string, valid_from timestamp_ntz"))
    expected = []
    for s in {r[1] for r in rows}:
        versions = facts.Versions()
        expected += [(n, s, v, at) for n, k, _, v, at in rows if k == s and versions.file(at, n, v)]
    assert got(found, "id", "subject", "value", "valid_from") == sorted(expected, key=str)
    assert "FlatMapGroupsInPandas" not in plan(found)


def test_plans_are_packed_in_batches(spark):
    """A call of Python for each plan took most of the time, and fell to few tasks."""
    said = turns(spark, HISTORY)
    asked = questions(spark, [("q1", "single-hop", "Which trick did Biscuit learn in Lisbon?", "", "2024-07-01 00:00")])
    shown = packing.packed_split(strategies.window_bm25(said, asked), said, asked, [40, 400], 0.25)
    assert "FlatMapGroupsInPandas" not in plan(shown)
    budgets = {}
    for row in shown.collect():
        budgets[row.budget] = budgets.get(row.budget, 0) + row.line_tokens + row.header_tokens
    assert set(budgets) == {40, 400} and all(spent <= b for b, spent in budgets.items())


def test_strong_interval_scores_leave_out_what_shares_common_words_alone(spark):
    rows, day = [], datetime(2024, 1, 1)
    for n in range(60):
        for k in range(3):
            rows.append((0, f"d{n}", day + timedelta(days=k * 5), day + timedelta(days=k * 5 + 5) if k < 2 else None, ["user", f"n{n}", "click" if n % 2 else "view", *["x"] * (n % 4)]))
    docs = spark.createDataFrame(rows, "history_id bigint, doc_id string, ts timestamp_ntz, until timestamp_ntz, terms array<string>")
    asked = [(f"q{n}", 0, day + timedelta(days=n % 14, hours=3), ["user", f"n{n}", "click"]) for n in range(0, 60, 7)] + [("common", 0, day + timedelta(days=3), ["user", "click", "x"]), ("early", 0, day - timedelta(days=3), ["user"]), ("none", 0, day, ["absent"])]
    q = spark.createDataFrame(asked, "qid string, history_id bigint, now timestamp_ntz, terms array<string>")
    every, strong = ({(r.qid, r.doc_id): round(r.score, 9) for r in timed.interval_scores(docs, q, share=s).collect()} for s in (0.0, 0.5))
    best = {}
    for (qid, _), score in every.items():
        best[qid] = max(best.get(qid, 0), score)
    wanted = {k: v for k, v in every.items() if v >= 0.5 * best[k[0]]}
    assert wanted.items() <= strong.items() and strong.items() <= every.items()
    assert sum(q != "common" for q, _ in strong) == sum(q.startswith("q") for q, *_ in asked) < sum(q != "common" for q, _ in every)


def test_postings_that_are_asked_for_are_written_once(spark):
    """Counting and scoring read one narrow table, rather than each shuffling the postings of all words."""
    docs = spark.createDataFrame([(0, "a", ["x", "y"]), (0, "b", ["x", "z"]), (0, "c", ["z"])], "history_id bigint, doc_id string, terms array<string>")
    asked = spark.createDataFrame([("q", 0, ["x", "x"])], "qid string, history_id bigint, terms array<string>")
    found = bm25.scores(bm25.build(docs), asked)
    written = [f for f in found.inputFiles() if "/wanted-" in f]
    assert written and {r.term for r in spark.read.parquet(*written).collect()} == {"x"}
    assert {r.doc_id for r in found.collect()} == {"a", "b"}


def test_common_terms_that_never_meet_bring_no_document_about(spark):
    """Two common words whose largest weights add up to the floor led each question to all documents that have one."""
    rows = [(0, f"d{n}", ["user", f"n{n}", "click" if n % 2 else "view", *["x"] * (12 if n >= 300 else 0)]) for n in range(400)]
    docs = spark.createDataFrame(rows, "history_id bigint, doc_id string, terms array<string>")
    asked = spark.createDataFrame([(f"q{n}", 0, ["user", f"n{n}", "click", "view"]) for n in range(300, 400)], "qid string, history_id bigint, terms array<string>")
    index, own = bounded.build(docs), bounded.distinct_terms(asked)
    floor = bounded.floors(index, own, 1).withColumn("floor", F.lit(1.6))
    told = {r.term for r in bounded.judged(index, own.join(floor, "qid")).where("tells").collect()}
    assert told == {f"n{n}" for n in range(300, 400)}
    assert bounded.candidates(index, own, floor).count() == 100


def test_facts_alike_are_scored_as_one_and_the_oldest_come_first(spark):
    day = datetime(2024, 1, 1)
    rows = [(f"user_{n}", "plan", "7", day + timedelta(days=400 - n), None, (day + timedelta(days=400 - n), n)) for n in range(400)] + [("user_x", "trip", "puppy", day, None, (day, 999))]
    held = spark.createDataFrame(rows, "subject string, attribute string, value string, valid_from timestamp_ntz, source_turn string, first struct<valid_from: timestamp_ntz, id: bigint>")
    said = spark.createDataFrame([], "source_turn string, text string")
    asked = questions(spark, [("q", "single-hop", "which plan", "", "2025-07-01 00:00"), ("none", "single-hop", "zebra", "", "2025-07-01 00:00")])
    found = memory.relevant_facts(held, said, asked)
    assert [r.subject for r in found.orderBy("rank").collect()] == [f"user_{n}" for n in range(399, 379, -1)]
    scored = [f for f in found.inputFiles() if "/weights-" in f]
    assert scored and spark.read.parquet(*scored).count() == 1
