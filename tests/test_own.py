"""What callers bring: a model behind a cache, policies and strategies of their own."""

import shutil
from pathlib import Path

import pytest
from helpers import HISTORY, got, questions, turns
from pyspark.sql import functions as F

from recollect import registry
from recollect.operators import evaluation, store
from recollect.plans import model, packing, strategies

DATA = "/root/testdata/sf0.001"


def prompts(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "n int, prompt string")


def counting(log, broken=None):
    def told(asked):
        if broken is not None and broken in asked:
            raise RuntimeError("the model is away")
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in asked)
        return [p.upper() for p in asked]

    return told


def test_each_prompt_is_asked_once_across_calls_and_reads(spark, tmp_path):
    log, cache = tmp_path / "log", model.Cache(spark, str(tmp_path / "cache"))
    first = cache.answered(prompts(spark, "a", "b", "a"), "prompt", counting(log), "m")
    want = [(0, "a", "A"), (1, "b", "B"), (2, "a", "A")]
    assert got(first, "n", "prompt", "reply") == got(first, "n", "prompt", "reply") == want
    assert sorted(log.read_text().split()) == ["a", "b"]
    second = cache.answered(prompts(spark, "b", "c"), "prompt", counting(log), "m")
    assert got(second, "prompt", "reply") == [("b", "B"), ("c", "C")]
    assert sorted(log.read_text().split()) == ["a", "b", "c"]
    cache.answered(prompts(spark, "c"), "prompt", counting(log), "m", options="cold")
    assert sorted(log.read_text().split()) == ["a", "b", "c", "c"]
    cache.merged()
    assert len([p for p in (tmp_path / "cache").iterdir() if p.is_dir()]) == 1 and cache.rows().count() == 4


def test_a_lost_attempt_leaves_nothing_that_is_read(spark, tmp_path):
    log, cache = tmp_path / "log", model.Cache(spark, str(tmp_path / "cache"))
    with pytest.raises(Exception, match="away"):
        cache.answered(prompts(spark, "x", "y", "bad").repartition(3), "prompt", counting(log, "bad"), "m", batch=1)
    assert cache.rows().count() == 0
    found = cache.answered(prompts(spark, "x", "y", "bad"), "prompt", counting(log), "m")
    assert got(found, "reply") == [("BAD",), ("X",), ("Y",)]
    before = log.read_text()
    cache.answered(prompts(spark, "x", "bad"), "prompt", counting(log), "m").collect()
    assert log.read_text() == before


def test_batches_of_two_callers_at_once_hold_a_key_once(spark, tmp_path):
    folder = tmp_path / "cache"
    cache = model.Cache(spark, str(folder), "vector array<double>")
    embed = lambda xs: [[float(len(x)), 1.0] for x in xs]
    cache.answered(prompts(spark, "abc"), "prompt", embed, "e")
    shutil.copytree(next(folder.iterdir()), folder / "twin")
    unfinished = folder / "unfinished"
    shutil.copytree(folder / "twin", unfinished)
    (unfinished / "_SUCCESS").unlink()
    assert got(cache.rows(), "vector") == [([3.0, 1.0],)]
    assert got(cache.answered(prompts(spark, "abc", "abc", "de"), "prompt", embed, "e"), "n", "vector") == [(0, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [2.0, 1.0])]
    cache.merged()
    assert unfinished.exists() and cache.rows().count() == 2


def test_a_predicate_in_python_is_a_policy(spark):
    t = turns(spark, HISTORY)
    short = store.predicate(lambda turn: turn.speaker == "user" and len(turn.text) < 12, "speaker", "text")
    assert got(store.applied(t, short), "id") == [(r.id,) for r in t.where("NOT (speaker = 'user' AND length(text) < 12)").orderBy("id").collect()]
    marked = store.forgotten(t.withColumn("forgotten_at", F.lit(None).cast("timestamp_ntz")), short, F.lit("2024-07-01").cast("timestamp_ntz"))
    assert got(marked.where("forgotten_at is not null"), "id") == got(t.where("speaker = 'user' AND length(text) < 12"), "id")
    assert store.applied(t.limit(0), short).count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")
def test_a_policy_of_ones_own_goes_through_the_study(spark):
    store.name_policy("assistants", lambda now: store.predicate(lambda turn: turn.speaker == "assistant", "speaker"))
    rows = registry.study_rows(spark, DATA, ("none", "assistants", "role:assistant"))
    kept = {r.policy: r.asDict() for r in rows.groupBy("policy").agg(F.count("*").alias("n"), F.sum("recall").alias("recall"), F.round(F.sum("tokens_kept"), 6).alias("kept")).collect()}
    assert set(kept) == {"none", "assistants", "role:assistant"} and kept["assistants"]["kept"] < kept["none"]["kept"]
    assert [kept["assistants"][c] for c in ("n", "recall", "kept")] == [kept["role:assistant"][c] for c in ("n", "recall", "kept")]
    for taken in ("phatic", "none", "a:b"):
        with pytest.raises(ValueError):
            store.name_policy(taken, lambda now: F.lit(True))


def test_a_strategy_of_ones_own_is_packed_and_scored(spark):
    t = turns(spark, HISTORY)
    q = questions(spark, [("q1", "single-hop", "which trick did Biscuit learn?", "", "2024-07-01 00:00"), ("q2", "single-hop", "zebra", "", "2024-07-01 00:00")])

    def longest(turns, questions):
        every = questions.select("qid", "history_id").join(turns, "history_id")
        return every.select("qid", F.expr("row_number() OVER (PARTITION BY qid ORDER BY length(text) DESC, id)").alias("unit_ord"), F.lit(0).alias("turn_ord"), F.col("id").alias("turn_id"))

    strategies.name_strategy("longest", longest)
    plans = strategies.planned(["longest", "bm25_turns"], t, q)
    assert plans.columns == list(strategies.PLAN)
    shown = packing.packed(plans, t, [30])
    evidence = spark.createDataFrame([("q1", "h", "s3:0")], "qid string, history_id string, turn_id string")
    gold = spark.createDataFrame([("q1", "s3")], "qid string, session_id string")
    found = evaluation.scores(shown, q, evidence, gold, t)
    by_strategy = {r.strategy: r.recall for r in found.where("qid = 'q1'").collect()}
    assert by_strategy == {"longest": 1.0, "bm25_turns": 1.0}
    with pytest.raises(ValueError, match="unknown"):
        strategies.planned(["nothing"], t, q)
    strategies.name_strategy("bad", lambda turns, questions: questions)
    with pytest.raises(ValueError, match="turn_ord"):
        strategies.planned(["bad"], t, q)
