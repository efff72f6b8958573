"""Turns of a memory in buckets of sessions: what one session changes writes one bucket."""

import json

import pytest
from pyspark.sql import functions as F

from recollect import cli


@pytest.fixture
def folder(spark, tmp_path, capsys):
    lines = [{"session": f"s{s}", "time": f"2024-01-{s + 1:02}T09:0{n}:00", "speaker": "guest" if s == 3 else "user", "text": f"word{s} and a longer saying number {n}"} for s in range(12) for n in range(3)]
    source = tmp_path / "turns.jsonl"
    source.write_text("\n".join(map(json.dumps, lines)))
    place = str(tmp_path / "memory")
    assert cli.main([place, "ingest", str(source)], spark) == 0
    assert "36 added" in capsys.readouterr().out
    return place


def turns(spark, folder):
    return {r.id: r for r in cli.Memory(spark, folder).read("turns").collect()}


def bucket_of(spark, session):
    return spark.createDataFrame([(session,)], "session_id string").select(cli.bucket().alias("b")).first().b


def changed(before, after):
    return {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}


def test_forgetting_and_purging_one_session_write_one_bucket(spark, folder, capsys):
    m, own = cli.Memory(spark, folder), bucket_of(spark, "s3")
    start = m.parts("turns")
    assert None not in start and len(start) > 5
    assert cli.main([folder, "forget", "role:guest", "2024-02-01"], spark) == 0
    forgotten = m.parts("turns")
    assert changed(start, forgotten) == {own}
    assert [r.session_id for r in turns(spark, folder).values() if r.forgotten_at] == ["s3"] * 3
    assert cli.main([folder, "purge"], spark) == 0
    assert changed(forgotten, m.parts("turns")) == {own}
    left = turns(spark, folder)
    assert len(left) == 33 and not any(r.session_id == "s3" for r in left.values())
    again = m.parts("turns")
    assert cli.main([folder, "purge"], spark) == 0 and cli.main([folder, "forget", "role:guest", "2024-02-01"], spark) == 0
    assert m.parts("turns") == again
    assert capsys.readouterr().out.split("\n")[:4] == ["3 forgotten", "3 purged", "0 purged", "0 forgotten"]


def test_a_turn_added_writes_its_bucket_and_compacting_those_cut(spark, folder, capsys):
    m = cli.Memory(spark, folder)
    start = m.parts("turns")
    assert cli.main([folder, "add", "s5", "user", "one two three four five six seven eight nine ten eleven twelve", "2024-03-01"], spark) == 0
    added = m.parts("turns")
    assert changed(start, added) == {bucket_of(spark, "s5")} and turns(spark, folder)["s5:3"].seq == 3
    assert cli.main([folder, "forget", "truncate:11", "2024-03-02"], spark) == 0
    assert changed(added, m.parts("turns")) == {bucket_of(spark, "s5")}
    assert turns(spark, folder)["s5:3"].text.endswith(" …") and len(turns(spark, folder)) == 37


def test_files_that_are_not_named_are_not_read_and_a_whole_table_is_dealt_out(spark, folder):
    m, every = cli.Memory(spark, folder), turns(spark, folder)
    m.read("turns").limit(5).write.parquet(f"{folder}/turns-lost/bucket=1")
    assert turns(spark, folder) == every
    m.write(turns=m.read("turns"))
    assert set(m.parts("turns")) == {None}
    assert cli.main([folder, "forget", "role:guest", "2024-02-01"], spark) == 0
    after = turns(spark, folder)
    assert None not in m.parts("turns") and after.keys() == every.keys()
    assert [r.text for k, r in sorted(after.items())] == [r.text for k, r in sorted(every.items())]
