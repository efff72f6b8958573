from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.functions import parsing, temporal, text


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(make(F.col("v"))).collect()]


def test_terms_of_sentences(spark):
    got = column(spark, ["The cats' toys are running!", "Alice's boxes, agreed: falling & passed", "let's go", "étions 42 été", "", None, "HELLO hello"], text.terms)
    assert got == [["cat", "toy", "run"], ["alic", "box", "agre", "fall", "pass"], ["let", "go"], ["tion", "42", "t"], [], None, ["hello", "hello"]]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("paintings", "paint"), ("painted", "paint"), ("moved", "mov"), ("moves", "mov"), ("moving", "mov"), ("studies", "study"), ("studied", "study"), ("churches", "church"), ("boss", "boss"), ("campus", "campus"), ("tennis", "tennis"), ("running", "run"), ("agreeing", "agre"), ("agreed", "agre"), ("quickly", "quick"), ("amazingly", "amaz"), ("bus", "bus"), ("1999", "1999"), ("stopped", "stop"), ("seeing", "see")],
)
def test_stems(spark, word, stem):
    assert column(spark, [word], lambda v: text.stems(F.array(v))) == [[stem]]


def test_token_counts_and_the_white_space_that_costs_nothing(spark):
    values = ["", "a", "abcdefgh", "abcdefghi", "x" * 14, "12", "1234", "a-b!", "a\u0085b　c\x1cd e", "🙂🙂", "it's 2024"]
    assert column(spark, values, text.count_tokens) == [0, 1, 1, 2, 3, 1, 2, 4, 5, 2, 5]


def test_truncation_is_the_longest_prefix_that_fits(spark):
    whole = " ".join(f"word{k}" for k in range(50))
    got = column(spark, ["short", "one  two\nthree four five six", "x" * 400, whole], lambda v: text.truncated(v, 4))
    assert got == ["short", "one two three …", " …", "word0 …"]
    assert all(n <= 4 for n in column(spark, got, text.count_tokens))
    with pytest.raises(ValueError):
        text.truncated(F.lit("x"), 0)


def test_a_verdict_ends_at_letters_beyond_ascii(spark):
    assert column(spark, ["yes\u00e9", "\u00c9NO yes", "\u65e5yes\u672c", "no\u0663", "n\u00f3 yes", "yes_ no", "yes1"], parsing.verdict) == [True, False, True, False, True, False, None]


def test_fact_keys_evidence_and_verdicts(spark):
    assert column(spark, ["  My  Name\t"], text.fact_key) == ["my name"]
    assert column(spark, ["D8:6; D9:17", "D:11:26", "D30:05", "D", "D1:1"], parsing.evidence_ids) == [["D8:6", "D9:17"], ["D11:26"], ["D30:5"], [], ["D1:1"]]
    assert column(spark, ["Yes.", "NO, yes", "yesterday", "well: yes", ""], parsing.verdict) == [True, False, None, True, None]


def test_extracted_facts(spark):
    replies = [
        'Sure!\n```[{"subject": "me", "attribute": "job", "value": 7, "turn": 0}, {"subject": " ", "attribute": "a", "value": "b", "turn": 0}]```',
        '[{"subject": "a", "attribute": "b", "value": "c", "turn": true}, {"subject": "a", "attribute": "b", "value": "c", "turn": 2}, {"subject": "a", "attribute": "b", "value": "", "turn": 1}, 5, {"subject": 1, "attribute": "b", "value": "c", "turn": 1}]',
        "no array", "[broken", "[]",
    ]
    got = column(spark, replies, lambda v: parsing.extracted_facts(v, F.lit(2)))
    assert [[tuple(f) for f in x] for x in got] == [[("me", "job", "7", 0)], [], [], [], []]


def test_split_is_the_hash_mod_five(spark):
    import hashlib

    names = [f"conv-{k}" for k in range(200)]
    want = ["dev" if int(hashlib.sha256(n.encode()).hexdigest(), 16) % 5 == 0 else "test" for n in names]
    assert column(spark, names, parsing.split_of) == want
    assert column(spark, ["c1:q7"], lambda v: parsing.cluster_of(F.lit("locomo"), v)) == ["c1"]
    assert column(spark, ["q7_abs"], lambda v: parsing.cluster_of(F.lit("longmemeval"), v)) == ["q7"]


def test_bag_embedding(spark):
    import hashlib

    want = [0.0] * 64
    for w in "the cat the hat".split():
        want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 64] += 1
    assert column(spark, ["The cat  the hat"], parsing.bag_embedding) == [want]


def test_timestamps(spark):
    values = ["1:56 pm on 8 May, 2023", "12:05 AM on 1 Jan 2024", "2023/05/20 (Sat) 02:21", "2023/05/20 02:21", "2024-01-01T09:00+05:00", "2024-01-01T09:00:30", "2024-01-01", " 2024-01-01T09:00Z ", "8 May", "25:00 pm on 8 May, 2023x", "1:00 pm on 8 Foo, 2023"]
    got = [None if t is None else f"{t:%Y-%m-%d %H:%M:%S}" for t in column(spark, values, temporal.parsed)]
    assert got == ["2023-05-08 13:56:00", "2024-01-01 00:05:00", "2023-05-20 02:21:00", "2023-05-20 02:21:00", "2024-01-01 04:00:00", "2024-01-01 09:00:30", "2024-01-01 00:00:00", "2024-01-01 09:00:00", None, None, None]
    forms = ["20240203", "20240203T0405", "20240203T040506", "20240203T0405+0530", "2024-02-03T04:05-0200", "2024-W05-6", "2024W056T0405", "2024-W05", "2020-W53-7", "2021-W53-1", "2024-W00-1", "20241301", "123456789"]
    read = [None if t is None else f"{t:%Y-%m-%d %H:%M:%S}" for t in column(spark, forms, temporal.parsed)]
    from_iso = [datetime.fromisoformat(x) for x in forms[:9]]
    naive = [x.replace(tzinfo=None) - (x.utcoffset() or timedelta()) for x in from_iso]
    assert read == [f"{x:%Y-%m-%d %H:%M:%S}" for x in naive] + [None] * 4
    with pytest.raises(Exception, match="unrecognised timestamp"):
        column(spark, ["nonsense"], temporal.parse_timestamp)


def test_windows(spark):
    now = F.lit("2023-06-15 12:00:00").cast("timestamp_ntz")
    cases = {
        "what did I do two weeks ago?": ("2023-05-25", "2023-06-08"), "in the past 3 days": ("2023-06-11", "2023-06-16"), "yesterday's news": ("2023-06-13", "2023-06-15"), "this week": ("2023-06-07", "2023-06-16"),
        "last month": ("2023-04-15", "2023-06-15"), "in May": ("2023-04-28", "2023-06-04"), "during december": ("2022-11-28", "2023-01-04"), "in early May 2021": ("2021-04-28", "2021-06-04"), "in 2020": ("2020-01-01", "2021-01-01"),
        "a couple of days ago": ("2023-06-11", "2023-06-15"), "last weekend": ("2023-06-08", "2023-06-15"), "no time here": None, "today": ("2023-06-14", "2023-06-16"),
    }
    got = column(spark, list(cases), lambda v: temporal.query_window(v, now))
    assert [None if w is None else (f"{w.lo:%Y-%m-%d}", f"{w.hi:%Y-%m-%d}") for w in got] == list(cases.values())
