import math
import random
from datetime import datetime

import pytest
from helpers import HISTORY, got, questions, turns
from pyspark.sql import functions as F

from recollect.operators import bm25
from recollect.plans import packing, strategies

SCHEMA = "history_id string, doc_id int, terms array<string>"


def score(spark, docs, query, **options):
    index = bm25.build(spark.createDataFrame([("h", k, d) for k, d in enumerate(docs)], SCHEMA))
    asked = spark.createDataFrame([("q", "h", query)], "qid string, history_id string, terms array<string>")
    return dict(got(bm25.scores(index, asked, **options), "doc_id", "score"))


def test_bm25_by_hand(spark):
    docs = [["a", "b", "a"], ["b", "c"], ["c", "c", "c", "d"]]
    found = score(spark, docs, ["a", "c", "a"])
    idf = lambda df: math.log(1 + (3 - df + 0.5) / (df + 0.5))
    one = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 3))
    assert found == pytest.approx({0: idf(1) * one(2, 3), 1: idf(2) * one(1, 2), 2: idf(2) * one(3, 4)})
    every = score(spark, [["x"]] * 10, ["x"])
    assert len(every) == 10 and all(v > 0 for v in every.values())
    assert score(spark, [], ["x"]) == {} and score(spark, [[]], ["x"]) == {}
    with pytest.raises(ValueError):
        score(spark, docs, ["a"], b=2)


def test_baselines_and_search(spark):
    t, q = turns(spark, HISTORY), questions(spark, [("q1", "t", "what trick did Biscuit learn", "", "2024-07-01 00:00")])
    ids = lambda plan: [r.turn_id for r in plan.orderBy("unit_ord", "turn_ord").collect()]
    flat = [f"{s}:{k}" for s, _, said in HISTORY for k in range(len(said))]
    assert ids(strategies.full_head(t, q)) == flat and ids(strategies.sliding_window(t, q)) == flat[::-1]
    assert sorted(ids(strategies.random_turns(t, q))) == sorted(flat) != ids(strategies.random_turns(t, q))
    assert ids(strategies.bm25_turns(t, q))[0] == "s3:0"
    assert ids(strategies.bm25_sessions(t, q))[:3] == ["s3:0", "s3:1", "s3:2"]
    assert ids(strategies.store(t, q))[0] == "s3:0"


def test_window_boost_decay_and_neighbours(spark):
    t = turns(spark, [("a", "2024-01-05 00:00", [("user", "the garden party"), ("x", "left"), ("user", "right")]), ("b", "2024-05-20 00:00", [("user", "the garden party")])])
    q = questions(spark, [("q1", "t", "garden party last month", "", "2024-06-15 00:00"), ("q2", "t", "garden party in january", "", "2024-06-15 00:00")])
    first = lambda config: dict(got(bm25.ranked(strategies.store_scores(t, q, config), "position", 1), "qid", "id"))
    assert first(strategies.Config()) == {"q1": "b:0", "q2": "a:0"}
    assert first(strategies.Config().without("window"))["q2"] == "b:0"
    units = strategies.store(t, q, strategies.Config(neighbours=1)).where("qid = 'q2' and unit_ord = 1")
    assert got(units, "turn_ord", "turn_id") == [(0, "a:0"), (2, "a:1")]
    with pytest.raises(ValueError):
        strategies.Config().without("nothing")


def test_fusion_prefers_what_both_rank(spark):
    rows = lambda xs: spark.createDataFrame([("q", "h", i, k, s) for k, (i, s) in enumerate(xs)], "qid string, history_id string, id string, position int, score double")
    found = strategies.fused(rows([("a", 3.0), ("b", 2.0), ("z", 0.0)]), rows([("b", 0.9), ("c", 0.5), ("a", -0.1)]))
    assert got(found, "rank", "id") == [(1, "b"), (2, "a"), (3, "c")]


def packed(name, t, q, budgets, share=0.25):
    if name in ("full_head", "sliding_window"):
        return packing.packed_prefix(t, q, budgets, name, name == "sliding_window")
    plan = getattr(strategies, name)(t, q)
    return packing.packed_split(plan, t, q, budgets, share) if name == "window_bm25" else packing.packed(plan, t, budgets)


def contexts(name, t, q, budgets, share=0.25):
    shown = packed(name, t, q, budgets, share)
    text = packing.rendered(shown)
    cost = text.select("qid", "budget", packing.count_tokens(F.col("body")).alias("n"), "body")
    return shown, {(r.qid, r.budget): (r.tokens, c.n, c.body) for r, c in zip(packing.totals(shown).orderBy("qid", "budget").collect(), cost.orderBy("qid", "budget").collect(), strict=True)}


@pytest.mark.parametrize("name", ["full_head", "sliding_window", "window_bm25", "store", "bm25_sessions"])
def test_what_is_rendered_costs_what_was_counted_and_fits(spark, name):
    rng = random.Random(1)
    words = "garden party lisbon biscuit naïve 1234567 extraordinarily ok!".split()
    sessions = [(f"s{k}", f"2024-0{k + 1}-0{k + 1} 10:00", [(rng.choice(["user", "assistant"]), " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), 20 * j) for j in range(6)]) for k in range(6)]
    t = turns(spark, sessions)
    q = questions(spark, [("q1", "t", "garden party in lisbon", "", "2024-07-01 00:00"), ("q2", "t", "extraordinary biscuit", "", "2024-07-01 00:00")])
    budgets = [0, 30, 77, 200, 100_000]
    shown, found = contexts(name, t, q, budgets)
    assert found and all(tokens == n <= budget for (_, budget), (tokens, n, _) in found.items())
    assert all(body.count(f"[session s{k} ") <= 1 for _, _, body in found.values() for k in range(6))
    if name in ("full_head", "sliding_window"):
        assert shown.where("cut").count() and found["q1", 200][0] > 170
        assert got(shown.where("budget = 100000 and qid = 'q1'"), "turn_id") == got(t, F.col("id").alias("turn_id"))


def test_a_prefix_ends_where_the_next_turn_does_not_fit(spark):
    rng = random.Random(5)
    sessions = [(f"s{k}", f"2024-03-{k + 10} 10:00", [("user", " ".join(["word"] * rng.randint(1, 25)), 30 * j) for j in range(5)]) for k in range(4)]
    t = turns(spark, sessions)
    q = questions(spark, [("q1", "t", "any", "", "2024-07-01 00:00")])
    price = {r.id: r for r in packing.costs(t).collect()}
    flat = [f"{s}:{k}" for s, _, said in sessions for k in range(len(said))]
    budgets = list(range(0, 420, 23))
    for name, order in (("full_head", flat), ("sliding_window", flat[::-1])):
        shown = packed(name, t, q, budgets)
        got_ = {b: {r.turn_id: r.cut for r in shown.where(f"budget = {b}").collect()} for b in budgets}
        for b in budgets:
            whole = [i for i, cut in got_[b].items() if not cut]
            assert whole == [] or set(whole) == set(order[: len(whole)])
            # The turns that fit, priced as they are rendered: a header for each session, of its first turn shown.
            total = lambda ids: sum(price[i].line_tokens for i in ids) + sum(price[min(i for i in ids if i[:2] == s)].header_tokens for s in {i[:2] for i in ids})
            fits = [n for n in range(len(order) + 1) if total(order[:n]) <= b]
            assert len(whole) == next(n for n in range(len(order) + 1) if n + 1 not in fits)


def test_a_repeated_turn_is_packed_once_and_a_later_one_may_fit(spark):
    t = turns(spark, [("a", "2024-01-05 00:00", [("u", "one " * 40), ("u", "two"), ("u", "three")])])
    plan = spark.createDataFrame([("q", "h", "x", k, 0, i) for k, i in enumerate(["a:1", "a:0", "a:1", "a:2"])], "qid string, history_id string, strategy string, unit_ord int, turn_ord int, turn_id string")
    assert got(packing.packed(plan, t, [25, 500]), "budget", "turn_id") == [(25, "a:1"), (25, "a:2"), (500, "a:0"), (500, "a:1"), (500, "a:2")]


def test_window_split_fills_the_rest_with_hits(spark):
    t, q = turns(spark, HISTORY), questions(spark, [("q1", "t", "puppy Biscuit", "", "2024-07-01 00:00")])
    shown, _ = contexts("window_bm25", t, q, [120], 0.4)
    ids = [r[0] for r in got(shown, "turn_id")]
    assert "s3:2" in ids and "s1:0" in ids


def test_packing_refuses_bad_budgets(spark):
    t, q = turns(spark, HISTORY), questions(spark, [("q1", "t", "puppy", "", "2024-07-01 00:00")])
    with pytest.raises(ValueError):
        packing.packed_prefix(t, q, [-1])
    with pytest.raises(ValueError):
        packing.packed_split(strategies.window_bm25(t, q), t, q, [10], 1.0)


def test_fact_lines_take_half_the_budget(spark):
    rows = [("q", k, "name / job: plumber (since 2024-01-01)") for k in range(5)]
    found = packing.fact_lines(spark.createDataFrame(rows, "qid string, fact_ord int, fact string"), 80)
    assert got(found, "fact_ord") == [(0,), (1,)] and datetime.now()
