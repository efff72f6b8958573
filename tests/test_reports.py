import math
import random

import pytest
from helpers import HISTORY, got, questions, turns
from pyspark.sql import functions as F

from recollect.operators import evaluation, reports, stats


def test_quantiles(spark):
    df = spark.createDataFrame([(1,), (6,), (30,), (31,), (200,)], "df int").select("df", stats.t975(F.col("df")).alias("t"))
    assert dict(got(df, "df", "t")) == pytest.approx({1: 12.706, 6: 2.447, 30: 2.042, 31: 2.0395, 200: 1.9719}, abs=2e-3)


def jackknife(values):
    by = {}
    for c, v in values:
        by.setdefault(c, []).append(v)
    total, n = sum(v for _, v in values), len(values)
    if len(by) < 2:
        return total / n, total / n, total / n
    loo = [(total - sum(vs)) / (n - len(vs)) for vs in by.values()]
    k, centre = len(loo), sum(loo) / len(loo)
    half = stats.T975[k - 2] * math.sqrt((k - 1) / k * sum((x - centre) ** 2 for x in loo))
    every = [v for _, v in values]
    return total / n, max(total / n - half, min(every)), min(total / n + half, max(every))


def test_cluster_means_match_a_plain_jackknife(spark):
    rng = random.Random(0)
    data = {g: [(rng.choice("abcdefg"[: g + 1]), rng.random()) for _ in range(40)] for g in range(6)}
    df = spark.createDataFrame([(g, c, v) for g, xs in data.items() for c, v in xs] + [(None, "a", 0.5), (0, "a", None)], "g int, cluster string, value double")
    found = {r.g: (r.mean, r.lo, r.hi) for r in stats.cluster_means(df, ["g"]).collect()}
    assert found.pop(None) == (0.5, 0.5, 0.5)
    for g, xs in data.items():
        assert found[g] == pytest.approx(jackknife(xs))


def test_bootstrap_brackets_the_mean_and_repeats(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("x", f"c{k % 20}", rng.random()) for k in range(400)], "g string, cluster string, value double")
    a, b = (stats.bootstrap(df, ["g"], resamples=300).first() for _ in range(2))
    assert a == b and 0.4 < a.boot_lo < 0.5 < a.boot_hi < 0.6


def scored(spark):
    t = turns(spark, HISTORY)
    q = questions(spark, [("q1", "knowledge-update", "x", "", "2024-07-01 00:00"), ("q2", "single-hop", "x", "", "2024-07-01 00:00"), ("q3", "single-hop", "x", "", "2024-07-01 00:00")])
    ev = spark.createDataFrame([("q1", "h", "s1:0"), ("q1", "h", "s3:0"), ("q1", "h", "gone"), ("q2", "h", "s2:0")], "qid string, history_id string, turn_id string")
    gs = spark.createDataFrame([("q1", "s1"), ("q1", "s3")], "qid string, session_id string")
    ctx = spark.createDataFrame([("q1", "a", 10, "s1:0", "s1", False), ("q1", "b", 10, "s3:0", "s3", True), ("q1", "b", 10, "s1:1", "s1", False)], "qid string, strategy string, budget int, turn_id string, session_id string, cut boolean")
    return evaluation.scores(ctx, q, ev, gs, t)


def test_scores(spark):
    cols = ("recall", "recall_strict", "all", "session_recall", "all_sessions", "newest", "stale_only", "measurable")
    found = {(r.qid, r.strategy): tuple(r[c] for c in cols) for r in scored(spark).collect()}
    assert found["q1", "a"] == (0.5, 0.5, False, 0.5, False, False, True, True)
    assert found["q1", "b"] == (0.5, 0.0, False, 1.0, True, True, False, True)
    assert found["q2", "a"] == (0.0, 0.0, False, None, None, None, None, True)
    assert found["q3", "b"] == (None, None, None, None, None, None, None, False)


ROWS = "dataset string, split string, strategy string, budget int, qid string, qtype string, cluster string, measurable boolean, recall double, tokens int"


def rows(spark):
    rng = random.Random(2)
    out = [("d", "test", s, b, f"q{k}", "tu"[k % 2], f"c{k % 5}", k != 9, None if k == 9 else round(rng.random() * b / 10, 4), b - 1) for s in "ab" for b in (5, 10) for k in range(20)]
    return out, spark.createDataFrame(out, ROWS)


def test_summaries_and_comparisons(spark):
    plain, df = rows(spark)
    s = {(r.strategy, r.budget, r.qtype): (r.n_questions, r.mean_tokens, r.n_measurable) for r in reports.summarise(df).collect()}
    assert s["a", 5, "all types"] == (20, 4.0, 19) and s["b", 10, "t"] == (10, 9.0, 10) and len(s) == 12
    means = reports.metric_means(df, metrics=("recall",))
    own = [(r[6], r[8]) for r in plain if r[2] == "a" and r[3] == 10 and r[8] is not None]
    m = next(r for r in means.collect() if (r.strategy, r.budget, r.qtype) == ("a", 10, "all types"))
    assert (m.mean, m.lo, m.hi) == pytest.approx(jackknife(own), abs=1e-4) and (m.n, m.clusters) == (19, 5)
    c = next(r for r in reports.compare(df, "a", "b", 10).collect() if r.qtype == "all types")
    value = {(r[2], r[4]): r[8] for r in plain if r[3] == 10}
    pairs = [(r[6], value["a", r[4]] - value["b", r[4]]) for r in plain if r[2] == "a" and r[3] == 10 and r[8] is not None]
    assert (c.mean, c.lo, c.hi) == pytest.approx(jackknife(pairs), abs=1e-4)
    reach = {(r.strategy, r.qtype): r.budget for r in reports.budget_to_reach(means, 0.3).collect()}
    assert reach["a", "all types"] == 10 and set(reach.values()) <= {5, 10, None}


def test_positions_answers_and_configs(spark):
    ev = spark.createDataFrame([("d", "test", s, 8, f"q{k}", f"c{k % 3}", f"t{k}", k / 11, (k + (s == "b")) % 2 == 0, k % 4 == 0) for s in "ab" for k in range(12)], "dataset string, split string, strategy string, budget int, qid string, cluster string, turn_id string, pos double, hit boolean, whole boolean")
    assert {(r.strategy, r.position): r.n for r in reports.by_position(ev, 8).collect()}["a", "0.9-1"] == 2
    diff = {(r.position, r.credit): (r.mean, r.n) for r in reports.position_differences(ev, "a", "b", 8).collect()}
    assert diff["0-0.25", "strict"] == (0.0, 3) and diff["0-0.25", "lenient"][0] == pytest.approx(1 / 3, abs=1e-4)
    ans = spark.createDataFrame([("d", "s", "t", "c1", True, 1.0), ("d", "s", "t", "c2", None, 0.0), ("d", "s", "u", "c3", False, None), ("d", "s", "u", "c3", True, 0.5)], "dataset string, strategy string, qtype string, cluster string, correct boolean, recall double")
    a = next(r for r in reports.summarise_answers(ans).collect() if r.qtype == "all types")
    assert (a.n, a.unparsed, a.mean, a.found_mean, a.found_n, a.missing_mean, a.missing_n) == (4, 1, 0.5, 1.0, 2, 0.0, 1)
    cfg = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.7), (0, "x", 0.6), (0, "y", 0.6), (2, "x", 0.1)], "config int, dataset string, recall double")
    assert got(reports.best_config(cfg).where("best"), "config", "macro") == [(0, 0.6)]


def test_why_evidence_is_hard_to_find(spark):
    t = turns(spark, HISTORY)
    q = questions(spark, [("q1", "t", "Which puppy did the user adopt?", "Biscuit", "2024-07-01 00:00"), ("q2", "t", "Where does the user live?", "Lisbon since February", "2024-07-01 00:00"), ("q3", "t", "x", "a cat", "2024-07-01 00:00")])
    ev = spark.createDataFrame([("q1", "h", "s1:0"), ("q2", "h", "s2:0"), ("q3", "h", "s3:0")], "qid string, history_id string, turn_id string")
    assert got(evaluation.visibility(q, ev, t), "qid", "visible") == [("q1", True), ("q2", False), ("q3", False)]
    assert got(evaluation.answer_location(q, ev, t), "qid", "location") == [("q1", "in_text"), ("q2", "elsewhere"), ("q3", "elsewhere")]
    dated = q.withColumn("answer", F.lit("Lisbon, 5th February 2024"))
    assert got(evaluation.answer_location(dated, ev.where("qid = 'q2'"), t), "location") == [("needs_date",)]
    assert got(evaluation.answer_present(q, ev, t), "qid", "present") == [("q1", True), ("q2", False), ("q3", False)]
    assert got(evaluation.positions(ev, t), "qid", "pos") == [("q1", 0.0), ("q2", 0.4444), ("q3", 0.7778)]
