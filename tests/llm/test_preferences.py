import random

from util import saved, same_as_sql

from recollect.llm import preferences as p
from recollect.llm import sql

TURNS = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (0, 0, "user", "hi"), (0, 1, "assistant", "good"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", "same"), (3, 0, "user", "same"),
    (4, 0, "system", None), (4, 1, None, "x"), (5, 0, "system", None), (5, 1, None, "x"), (5, 2, "assistant", ""), (6, 0, "user", "alone"), (None, 0, "user", "nobody"), (8, 0, "user", "a"), (8, 0, "user", "a"),
    (9, 0, "user", "a"), (9, 1, "assistant", "é🙂"), (11, 0, "user", "odd one"),
]


def found(spark, rows=ROWS):
    turns = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' as side", "1 as t", "'y' as pair_id")
    return {r.pair_id: r for r in p.formatted(p.neighbour_pairs(turns), turns).collect()}


def test_prefix_is_rendered_once(spark):
    got = found(spark)
    r = got[0]
    assert r.prompt_turns == 1 and r.prompt == "<|user|>\nhi<|end|>\n" and r.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [r.chosen[s.start : s.stop] for s in r.chosen_spans] == ["good<|end|>\n"] and [r.rejected[s.start : s.stop] for s in r.rejected_spans] == ["bad<|end|>\n"]
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert got[2].prompt_turns == 2 and got[2].chosen == "" and got[2].rejected == "<|assistant|>\n<|end|>\n"
    assert (got[3].rejected_id, got[3].prompt, got[3].rejected, got[3].chosen) == (None, "", "", "<|user|>\nalone<|end|>\n")
    assert got[4].prompt_turns == 1 and [got[4].rejected[s.start : s.stop] for s in got[4].rejected_spans] == ["é🙂<|end|>\n"]
    assert got[5].chosen_id is None and len(got) == 6


def test_same_as_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = ROWS + [(100 + c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "x" * 40])) for c in range(60) for t in range(rng.randint(1, 5))]
    folder = saved(tmp_path, conversations=spark.createDataFrame(rows, TURNS))
    same_as_sql(p.op10_preference_format(spark, folder), folder, sql.OP10, ["conversations"])


def test_no_rows(spark):
    assert found(spark, []) == {}


def test_very_long_conversations_take_time_by_their_turns(spark):
    turns = spark.range(12_000).selectExpr("id % 2 as conv_id", "id div 2 as turn", "if(id div 2 % 2 = 0, 'user', 'assistant') as role", "concat('turn ', id div 2, if(id = 9001, ' other', '')) as text")
    (r,) = p.formatted(p.neighbour_pairs(turns), turns).collect()
    assert r.prompt_turns == 4500 and len(r.chosen_spans) == len(r.rejected_spans) == 750
    assert all(r.rejected[s.start : s.stop].endswith("<|end|>\n") and r.rejected[: s.start].endswith("<|assistant|>\n") for s in r.rejected_spans)
    assert r.rejected.startswith("<|user|>\nturn 4500 other<|end|>")
