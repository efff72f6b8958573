"""Questions that each see the turns said by their own time, against one index built for each time."""

from datetime import datetime, timedelta

import pytest
from helpers import got, questions, turns
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.operators import store, timed
from recollect.plans import strategies

SESSIONS = [
    ("s1", "2024-01-10 09:00", [("user", "The red boat sails to the island"), ("assistant", "A red boat?", 2), ("user", "Yes, the boat is red", 500)]),
    ("s2", "2024-01-10 09:00", [("user", "We fish from the boat"), ("assistant", "ok", 1)]),
    ("s3", "2024-02-01 08:00", [("user", "The island has a lighthouse"), ("user", "Sailing to the lighthouse took a day", 5), ("user", "The boat leaks", 30)]),
    ("s4", "2024-03-01 08:00", [("user", "Sold the boat, bought a red kite")]),
]
TIMES = ["2024-01-01 00:00", "2024-01-10 09:00", "2024-01-10 10:30", "2024-01-20 00:00", "2024-02-01 13:00", "2024-02-05 00:00", "2024-06-01 00:00"]
TEXTS = ["where does the red boat sail", "who saw the lighthouse last month", "kites and islands"]


def one_by_one(spark, said, asked, score, *cols):
    """The questions of each time over the history as it stood then."""
    out = []
    for (now,) in asked.select("now").distinct().collect():
        out += got(score(store.history_at(said, F.lit(now)), asked.where(F.col("now") == now)), *cols)
    return sorted(out, key=str)


def rounded(df):
    return df.withColumn("score", F.round("score", 9))


TIMES_ASKED = [(f"q{k}{n}", "single-hop", text, "", now) for k, text in enumerate(TEXTS) for n, now in enumerate(TIMES)]


def test_each_question_sees_its_own_time(spark):
    said, asked = turns(spark, SESSIONS), questions(spark, TIMES_ASKED)
    cols = ("qid", "id", "score")
    found = got(rounded(strategies.store_scores(said, asked, visible=True)), *cols)
    assert found == one_by_one(spark, said, asked, lambda h, q: rounded(strategies.store_scores(h, q)), *cols)
    assert len({q for q, *_ in found}) > 10 and not [q for q, *_ in found if q.endswith("0")]


def test_units_and_neighbours_leave_later_turns_out(spark):
    said, config = turns(spark, SESSIONS), strategies.Config(neighbours=2)
    asked = questions(spark, [(f"q{n}", "single-hop", "the lighthouse and the boat", "", now) for n, now in enumerate(TIMES) if n in (2, 3, 5)])
    cols = ("qid", "unit_ord", "turn_ord", "turn_id")
    assert got(strategies.store(said, asked, config, visible=True), *cols) == one_by_one(spark, said, asked, lambda h, q: strategies.store(h, q, config), *cols)


def test_all_seen_is_the_plain_search(spark):
    said = turns(spark, SESSIONS)
    asked = questions(spark, [("q", "single-hop", TEXTS[0], "", "2030-01-01 00:00")])
    assert got(rounded(strategies.turn_scores(said, asked, visible=True)), "id", "score") == got(rounded(strategies.turn_scores(said, asked)), "id", "score")


DAY = datetime(2024, 5, 1)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 300)), st.integers(-5, 5)), max_size=30), st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.one_of(st.none(), st.integers(0, 300))), max_size=12))
def test_totals_are_those_of_a_loop(spark, rows, probes):
    at = lambda h: None if h is None else DAY + timedelta(hours=h)
    r = spark.createDataFrame([(k, at(h), v) for k, h, v in rows], "k string, ts timestamp_ntz, v int")
    p = spark.createDataFrame([(n, k, at(h)) for n, (k, h) in enumerate(probes)], "n int, k string, now timestamp_ntz")
    found = {x.n: (x.sum, x.many) for x in timed.totals_as_of(r, p, ["k"], "ts", "now", {"sum": F.col("v"), "many": F.lit(1)}).collect()}
    for n, (k, h) in enumerate(probes):
        own = [v for key, t, v in rows if key == k and t is not None and h is not None and t <= h]
        assert found[n] == (sum(own), len(own))
    assert len(found) == len(probes)


def test_bad_parameters(spark):
    index = timed.build(spark.createDataFrame([], "history_id string, doc_id string, ts timestamp_ntz, terms array<string>"))
    none = spark.createDataFrame([], "qid string, history_id string, now timestamp_ntz, terms array<string>")
    assert timed.scores(index, none).count() == 0
    with pytest.raises(ValueError):
        timed.scores(index, none, b=2)
