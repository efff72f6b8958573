import hashlib
import json

import pytest
from helpers import got

from recollect.sources import files, sinks


def write(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text, "utf-8")
    return str(p)


LINES = [
    {"session": "a", "time": "2024-01-02T10:00:00", "speaker": "user", "text": "morning"},
    {"session": 7, "time": "2024-01-01T09:00+05:00", "speaker": "user", "text": "number"},
    {"session": "a", "time": "2024-01-01T10:00:00", "speaker": "bot", "text": "earlier"},
    {"session": "a", "time": "2024-01-02T10:00:00", "speaker": "user", "text": "morning"},
]


def test_jsonl_turns(spark, tmp_path):
    path = write(tmp_path, "a.jsonl", "\n\n".join(map(json.dumps, LINES)) + "\n  \n")
    digest = lambda key, n: hashlib.sha1(f"{key}|{n}".encode()).hexdigest()[:12]
    key = "2024-01-02T10:00:00|user|morning"
    found = got(files.read_jsonl(spark, path), "id", "session_id", "seq")
    assert found == sorted([(f"a:{digest(key, 1)}", "a", 0), (f"a:{digest('2024-01-01T10:00:00|bot|earlier', 1)}", "a", 1), (f"a:{digest(key, 2)}", "a", 2), (f"7:{digest('2024-01-01T04:00:00|user|number', 1)}", "7", 0)], key=str)
    starts = {f"{r.session_ts:%Y-%m-%d %H:%M}" for r in files.read_jsonl(spark, path).where("session_id = 'a'").collect()}
    assert starts == {"2024-01-01 10:00"}


@pytest.mark.parametrize(
    ("line", "why"),
    [("{oops", "not a JSON object"), ("[1]", "not a JSON object"), ('{"session": "a"}', "missing 'time'"), ('{"session": true, "time": "2024-01-01", "speaker": "u", "text": "x"}', "'session'"), ('{"session": "a", "time": "2024-01-01", "speaker": null, "text": "x"}', "'speaker'"), ('{"session": "a", "time": "soon", "speaker": "u", "text": "x"}', "'time'"), ('{"session": "a", "time": "2024-01-01", "speaker": "u", "text": 5}', "'text'")],
)
def test_bad_lines_are_named(spark, tmp_path, line, why):
    path = write(tmp_path, "bad.jsonl", json.dumps(LINES[0]) + "\n" + line + "\n")
    problems = [r.problem for r in files.jsonl_lines(spark, path).where("problem is not null").collect()]
    assert len(problems) == 1 and why in problems[0]
    with pytest.raises(Exception, match=r"bad line: \S*bad.jsonl:2: "):
        files.read_jsonl(spark, path).collect()


def test_lines_are_numbered_along_many_ranges(spark, tmp_path):
    """Blank lines count, and lines longer than a range; each file has numbers of its own."""
    want = {"a": [("x" * (k * 37 % 500) if k % 5 else "") for k in range(200)], "b": ["one"], "c": ["é" * 700, "", "last"]}
    for name, lines in want.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "301")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for name, lines in want.items():
        assert sorted((r.line, r.value) for r in rows if r.file.endswith(f"/{name}.jsonl")) == list(enumerate(lines, 1))


DIALOGUE = [
    {
        "sample_id": "c1",
        "conversation": {
            "speaker_a": "Ines",
            "speaker_b": "Otto",
            "session_1_date_time": "7:05 am on 3 March, 2021",
            "session_1": [{"speaker": "Ines", "dia_id": "D1:1", "text": "morning"}, {"speaker": "Otto", "dia_id": "D1:2", "text": "look", "blip_caption": "two boats"}],
            "session_2_date_time": "4:40 pm on 12 March, 2021",
            "session_2": [{"speaker": "Ines", "dia_id": "D2:1", "text": "bye"}],
            "session_4_date_time": "4:40 pm on 12 March, 2022",
            "session_4": [{"speaker": "Ines", "dia_id": "D4:1", "text": "after a gap"}],
        },
        "qa": [
            {"question": "what?", "answer": "two boats", "evidence": ["D1:2; D2:01", "D8:31"], "category": 1},
            {"question": "who?", "adversarial_answer": "Otto", "evidence": ["D1:1"], "category": 5},
            {"question": "when?", "answer": 2021, "evidence": ["D"], "category": 2},
        ],
    }
]


def test_dialogues(spark, tmp_path):
    path = write(tmp_path, "d.json", json.dumps(DIALOGUE, indent=1))
    c = files.read_dialogues(spark, path)
    assert got(c.turns, "id", "session_id", "text", "seq") == [("c1:D1:1", "c1:S1", "morning", 0), ("c1:D1:2", "c1:S1", "look [shares a photo: two boats]", 1), ("c1:D2:1", "c1:S2", "bye", 0)]
    assert got(c.questions, "qid", "qtype", "raw_type") == [("c1:q0", "multi-hop", "1"), ("c1:q1", "abstention", "5"), ("c1:q2", "temporal", "2")]
    answers = dict(got(c.questions, "qid", "answer"))
    assert answers["c1:q2"] == "2021" and "Otto" in answers["c1:q1"] and {f"{r.now:%Y-%m-%d %H:%M}" for r in c.questions.collect()} == {"2021-03-12 16:40"}
    assert got(c.evidence, "qid", "turn_id") == [("c1:q0", "c1:D1:2"), ("c1:q0", "c1:D2:1"), ("c1:q1", "c1:D1:1")]
    assert got(c.sessions, "qid", "session_id") == [("c1:q0", "c1:S1"), ("c1:q0", "c1:S2"), ("c1:q1", "c1:S1")]
    assert got(files.evidence_audit(spark, path), "evidence_strings", "exact", "repaired", "unresolvable") == [(4, 1, 1, 2)]


def haystack(**changes):
    say = lambda *xs: [{"role": r, "content": t, **({"has_answer": True} if gold else {})} for r, t, gold in xs]
    return {
        "question_id": "h1", "question_type": "knowledge-update", "question": "q", "answer": 5, "question_date": "2022/06/15 (Wed) 08:20", "haystack_session_ids": ["late", "old", "old"], "haystack_dates": ["2022/08/21 (Sun) 11:45", "2022/02/06 (Sun) 19:10", "2022/02/06 (Sun) 19:10"],
        "haystack_sessions": [say(("user", "x", False)), say(("user", "y", True), ("assistant", "z", False)), say(("user", "y", True), ("assistant", "z", False))], "answer_session_ids": ["old", "late"], **changes,
    }


def test_haystacks(spark, tmp_path):
    path = write(tmp_path, "h.json", json.dumps([haystack(), haystack(question_id="h2_abs", answer_session_ids=[], haystack_session_ids=["a"], haystack_dates=["2022/02/06 (Sun) 19:10"], haystack_sessions=[[{"role": "user", "content": "w"}]])]))
    c = files.read_haystacks(spark, path)
    assert got(c.turns, "id", "seq") == [("h1:late:0", 0), ("h1:old:0", 0), ("h1:old:1", 1), ("h2_abs:a:0", 0)]
    assert got(c.evidence, "qid", "turn_id") == [("h1", "h1:old:0")]
    found = {r.qid: (r.qtype, r.raw_type, r.answer, r.flags) for r in c.questions.collect()}
    assert found == {"h1": ("knowledge-update", "knowledge-update", "5", ["duplicate_sessions", "future_sessions", "partial_key"]), "h2_abs": ("abstention", "knowledge-update_abs", "5", [])}
    assert got(c.sessions, "qid", "session_id") == [("h1", "late"), ("h1", "old")]


def test_haystacks_that_contradict_themselves(spark, tmp_path):
    two = haystack()
    two["haystack_sessions"][2] = [{"role": "user", "content": "other"}]
    with pytest.raises(Exception, match="twice with different turns"):
        files.read_haystacks(spark, write(tmp_path, "two.json", json.dumps([two]))).turns.collect()
    with pytest.raises(Exception, match="differ in length"):
        files.read_haystacks(spark, write(tmp_path, "len.json", json.dumps([haystack(haystack_dates=[])]))).turns.collect()
    with pytest.raises(Exception):
        files.read_haystacks(spark, write(tmp_path, "cut.json", json.dumps([haystack()])[:-9])).turns.collect()


def test_rows_and_summaries_are_written_and_missing_files_named(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 else "x", k / 4) for k in range(50)], "n int, kind string, share double")
    path = str(tmp_path / "rows")
    sinks.write_rows(df.repartition(5), path, ["n"])
    first = {p.name.split("-")[1]: p.read_bytes() for p in (tmp_path / "rows").glob("part-*.json.gz")}
    sinks.write_rows(df.repartition(3), path, ["n"])
    again = {p.name.split("-")[1]: p.read_bytes() for p in (tmp_path / "rows").glob("part-*.json.gz")}
    assert first == again and got(spark.read.schema(df.schema).json(path), *df.columns) == got(df, *df.columns)
    sinks.write_summary(df.where("n < 3"), str(tmp_path / "summary"), ["n"], about="a test")
    (text,) = [p.read_text() for p in (tmp_path / "summary").glob("part-*.json") if p.stat().st_size]
    assert json.loads(text) == {"about": "a test", "rows": [{"n": k, "kind": None if k % 3 else "x", "share": k / 4} for k in range(3)]}
    assert sinks.located(spark, str(tmp_path), "summary").endswith("/summary")
    with pytest.raises(FileNotFoundError, match="nothing.jsonl"):
        sinks.located(spark, str(tmp_path), "nothing.jsonl")
