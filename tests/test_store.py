import random
from datetime import datetime, timedelta

import pytest
from helpers import HISTORY, got, turns
from pyspark.sql import functions as F

from recollect.operators import facts, store

FACTS = "id bigint, subject string, attribute string, value string, valid_from timestamp_ntz, source_turn string"


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def arrivals(spark, *rows):
    return spark.createDataFrame([(k + 1, *r, day(d), None) for k, (*r, d) in enumerate(rows)], FACTS)


def test_newer_values_supersede_and_restatements_do_nothing(spark):
    a = arrivals(spark, ("User", "job", "baker", 0), ("user ", "JOB", " Baker", 3), ("user", "job", "pilot", 5), ("user", "job", "baker", 9))
    for filed in (facts.filed(a), facts.filed_in_order(a)):
        assert got(facts.chained(filed), "id", "value", "superseded_by") == [(1, "baker", 3), (3, "pilot", 4), (4, "baker", None)]
    assert [r.value for r in facts.history_of(facts.filed(a), " USER", "job").collect()] == ["baker", "pilot", "baker"]


def test_late_values_slot_in(spark):
    a = arrivals(spark, ("u", "city", "rome", 3), ("u", "city", "rome", 1), ("u", "city", "oslo", 2), ("u", "city", "oslo", 2))
    filed = facts.filed(a)
    assert got(facts.chained(filed), "id", "superseded_by") == [(1, None), (2, 3), (3, 1)]
    held = lambda n: got(facts.as_of(filed, F.lit(day(n)).cast("timestamp_ntz")), "value")
    assert held(0) == [] and held(1) == [("rome",)] and held(2) == [("oslo",)] and held(9) == [("rome",)]


def test_filing_matches_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice("uv"), "a", rng.choice("xyz"), rng.randint(0, 20)) for _ in range(120)]
    kept, versions = [], {}
    for k, (s, _, v, d) in enumerate(rows, 1):
        prior = sorted(x for x in versions.get(s, []) if x[0] <= d)
        if not prior or prior[-1][2] != v:
            versions.setdefault(s, []).append((d, k, v))
            kept.append((k,))
    assert got(facts.filed(arrivals(spark, *rows)), "id") == sorted(kept, key=str)


def test_probes_match_as_of(spark):
    filed = facts.filed(arrivals(spark, ("u", "a", "x", 1), ("u", "a", "y", 4), ("v", "a", "z", 2)))
    probes = spark.createDataFrame([(k, s, "a", day(d)) for k, (s, d) in enumerate([("u", 0), ("u", 1), ("u", 3), ("u", 4), ("v", 9), ("w", 9)])], "probe_id bigint, subject string, attribute string, at timestamp_ntz")
    assert got(facts.as_of_each(filed, probes), "probe_id", "value") == [(0, None), (1, "x"), (2, "x"), (3, "y"), (4, "z"), (5, None)]


def test_current_ignores_the_clock_and_empty_keys_fail(spark):
    filed = facts.filed(arrivals(spark, ("u", "a", "x", 1), ("u", "a", "y", 9999)))
    assert got(facts.current(filed, " U "), "value") == [("y",)]
    with pytest.raises(Exception, match="must all have text"):
        facts.filed(arrivals(spark, ("u", " ", "x", 1))).collect()


def stored(spark, batch):
    none = batch.limit(0).select("id", "session_id", F.lit(0).cast("bigint").alias("seq"), "speaker", "text", "ts", F.lit(None).cast("timestamp_ntz").alias("forgotten_at"))
    return none, batch.limit(0).select(F.col("session_id").alias("id"), F.col("ts").alias("started_at"), F.lit(0).cast("bigint").alias("next_seq"))


def test_ingest_is_idempotent_and_continues_sessions(spark):
    rows = [(0, "a:0", "a", "x"), (1, "a:1", "a", " \n"), (2, "a:2", "a", "y"), (3, "a:0", "b", "again"), (4, "c:0", "c", "")]
    make = lambda xs: spark.createDataFrame([(o, 0, i, s, day(o), "user", t, day(o)) for o, i, s, t in xs], "input_ord int, session_ord int, id string, session_id string, session_ts timestamp_ntz, speaker string, text string, ts timestamp_ntz")
    t, s, n = store.ingested(*stored(spark, make(rows)), make(rows))
    assert got(t, "id", "session_id", "seq") == [("a:0", "a", 0), ("a:2", "a", 1)]
    assert got(n, "added", "already_stored", "empty") == [(2, 1, 2)] and got(s, "id", "next_seq") == [("a", 2), ("b", 0)]
    t2, s2, n2 = store.ingested(t, s, make(rows))
    assert got(n2, "added", "already_stored", "empty") == [(0, 3, 2)] and t2.count() == 2
    t3, s3, _ = store.ingested(t2, s2, make([(9, "a:9", "a", "new"), (8, "d:0", "d", "z")]))
    assert ("a:9", 2) in got(t3, "id", "seq") and ("a", day(0), 3) in got(s3, "id", "started_at", "next_seq")


def test_policies_forget_compact_and_purge(spark):
    now = F.lit("2024-07-01").cast("timestamp_ntz")
    t = turns(spark, HISTORY).withColumn("forgotten_at", F.lit(None).cast("timestamp_ntz"))
    gone = lambda spec: t.count() - store.live(store.forgotten(t, store.policy(spec, now)[0], now)).count()
    assert (gone("phatic"), gone("phatic:1"), gone("role:assistant"), gone("older-than:30")) == (6, 1, 4, 7)
    for bad in ("phatic:x", "role:", "truncate:0", "other:1", "older-than:"):
        with pytest.raises(ValueError):
            store.policy(bad, now)
    assert store.policy("truncate:5", now) == (None, 5)
    short = store.compacted(t, 4)
    assert short.where("changed").count() == 4 and got(short.where("id = 's1:0'"), "text") == [("I adopted a …",)]
    f = spark.createDataFrame([(1, "s1:0"), (2, "s1:1"), (3, None)], "id bigint, source_turn string")
    left, cleared = store.purged(store.forgotten(t, store.by_speaker("user"), now), f)
    assert left.count() == 4 and got(cleared, "id", "source_turn") == [(1, None), (2, "s1:1"), (3, None)]
    assert store.history_at(t, F.lit("2024-02-01").cast("timestamp_ntz")).count() == 4
    assert store.applied(t, store.phatic(100)).count() == 0
