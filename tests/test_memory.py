import json

import pytest
from helpers import HISTORY, got, questions, turns
from pyspark.sql import functions as F

from recollect import cli
from recollect.operators import facts
from recollect.plans import memory, model
from recollect.functions.text import count_tokens


def test_context_shows_facts_first_and_fits(spark):
    t = turns(spark, HISTORY)
    arrivals = spark.createDataFrame([(1, "user", "city", "Porto", "2024-01-01", None), (2, "user", "city", "Lisbon", "2024-03-05", "s2:0"), (3, "user", "pet", "Biscuit", "2024-01-10", "s1:0")], "id bigint, subject string, attribute string, value string, d string, source_turn string")
    filed = facts.filed(arrivals.withColumn("valid_from", F.col("d").cast("timestamp_ntz")).drop("d"))
    q = questions(spark, [("q1", "t", "which city did we move to, Lisbon?", "", "2024-07-01 00:00"), ("q2", "t", "zebra", "", "2024-07-01 00:00")])
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    for budget in (40, 90, 400):
        found = {r.qid: r for r in memory.contexts(t, filed, q, at("2024-07-01"), budget).collect()}
        assert set(found) <= {"q1"} and all(r.tokens <= budget for r in found.values())
    body = found["q1"].body.split("\n")
    assert body[0].startswith("[known facts") and body[1] == "user / city: Lisbon (since 2024-03-05)" and "user: We moved to Lisbon last month" in body
    early = memory.contexts(t, filed, q, at("2024-02-01"), 400).collect()
    assert [r.body.split("\n")[1] for r in early] == ["user / city: Porto (since 2024-01-01)"]
    assert count_tokens is not None


def test_each_question_has_the_context_of_its_own_time(spark):
    """Facts and turns: as with one time for all, question by question."""
    t = turns(spark, HISTORY)
    arrivals = spark.createDataFrame(
        [(1, "user", "city", "Porto", "2024-01-01", None), (2, "user", "city", "Lisbon", "2024-03-05", "s2:0"), (3, "user", "pet", "Biscuit", "2024-01-10", "s1:0"), (4, "user", "city", "Faro", "2024-06-01", "s3:0"), (5, "cat", "city", "Faro", "2024-06-01", None)],
        "id bigint, subject string, attribute string, value string, d string, source_turn string",
    )
    filed = facts.filed(arrivals.withColumn("valid_from", F.col("d").cast("timestamp_ntz")).drop("d"))
    days = ("2023-12-01", "2024-03-05", "2024-06-10")
    q = questions(spark, [(f"q{k}", "t", "which city did we move to, Lisbon or Porto, with Biscuit the user's pet?", "", f"{day} 12:00") for k, day in enumerate(days)])
    found = got(memory.contexts(t, filed, q, None, 200), "qid", "tokens", "body")
    want = []
    for k, day in enumerate(days):
        want += got(memory.contexts(t, filed, q.where(F.col("qid") == f"q{k}"), F.lit(f"{day} 12:00").cast("timestamp_ntz"), 200), "qid", "tokens", "body")
    assert found == sorted(want, key=str) and len(found) == 2


def test_replies_are_asked_once_and_parsed(spark):
    prompts = spark.createDataFrame([("a", "one fact"), ("b", "one fact"), ("c", "known")], "id string, prompt string")
    known = prompts.where("id = 'c'").select(model.key("m", F.col("prompt")).alias("key"), F.lit("cached").alias("reply"))
    told = model.Scripted({"fact": '[{"subject": "me", "attribute": "pet", "value": "cat", "turn": 1}]'}, "none")
    found, new = model.replies(prompts, known, told, "m")
    assert new.count() == 1 and dict(got(found, "id", "reply"))["c"] == "cached"
    texts = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "abc")], "n int, text string")
    kept = texts.where("n = 3").select(model.key("e", F.col("text")).alias("key"), F.array(F.lit(9.0)).alias("vector"))
    lengths, fresh = model.vectors(texts, kept, lambda xs: [[float(len(x)), 1.0] for x in xs], "e")
    assert got(lengths, "n", "vector") == [(1, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [9.0])] and fresh.count() == 1
    rows = found.where("id = 'a'").withColumn("turn_ids", F.array(F.lit("t0"), F.lit("t1"))).withColumn("valid_from", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert got(model.extracted(rows), "subject", "value", "source_turn") == [("me", "cat", "t1")]
    graded = model.graded(spark.createDataFrame([("Yes!",), ("no",), ("perhaps",)], "reply string"))
    assert got(graded, "correct") == [(False,), (None,), (True,)]
    texts = spark.range(1).select(model.grade_prompt(F.lit("temporal"), F.lit("Q?"), F.lit("G"), F.lit("R")).alias("p"), model.answer_prompt(F.lit("C"), F.lit("Q?"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("a"), model.extract_prompt(F.lit("D"), F.lit("0 x")).alias("e")).first()
    assert model.RULES["temporal"] in texts.p and "2024-01-01" in texts.a and texts.e.endswith("D\n0 x")


def test_commands(spark, tmp_path, capsys):
    lines = tmp_path / "in.jsonl"
    lines.write_text("\n".join(json.dumps({"session": s, "time": t, "speaker": "user", "text": x}) for s, t, x in [("a", "2024-01-01T10:00:00", "I bought a kayak"), ("a", "2024-01-01T10:01:00", " "), ("b", "2024-02-01T10:00:00", "oh hi")]))
    folder = str(tmp_path / "store")

    def run(*args):
        code = cli.main([folder, *args], spark)
        return code, capsys.readouterr().out.strip().splitlines()

    assert run("stats")[0] == 1
    assert run("ingest", str(lines)) == (0, ["2 added, 0 already stored, 1 empty"]) and run("ingest", str(lines)) == (0, ["0 added, 2 already stored, 1 empty"])
    assert run("add", "a", "user", "the kayak is red", "2024-03-01T09:00:00") == (0, ["1 added, 0 already stored, 0 empty"])
    assert run("add", "a", "user", " \t", "2024-03-01T09:00:00")[0] == 1
    for value, day in (("red", "2024-01-01"), ("blue", "2024-04-01")):
        assert run("remember", "Kayak", "colour", value, day)[0] == 0
    assert run("facts", "2024-02-01")[1] == ["kayak / colour: red (since 2024-01-01)"] and len(run("history", "kayak", "colour")[1]) == 2
    assert run("search", "kayak", "2024-02-15")[1] == ["2024-01-01 10:00 user: I bought a kayak"]
    assert "kayak / colour: blue (since 2024-04-01)" in run("context", "what colour is the kayak", "2024-05-01")[1]
    assert run("forget", "phatic:1", "2024-05-01")[1] == ["1 forgotten"] and run("purge")[1] == ["1 purged"]
    assert run("stats")[1] == ["sessions: 2", "turns: 2", "forgotten_turns: 0", "facts_current: 1", "facts_superseded: 1"]
    with pytest.raises(ValueError):
        run("forget", "nothing", "2024-05-01")
