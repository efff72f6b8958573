import random

import pytest
from util import docs, rows, same_as_sql, saved

from recollect.llm import decontaminate as d
from recollect.llm import sql

ITEMS = "item_id bigint, text string"
FILL = [f"filler{k}" for k in range(400)]


def case(spark):
    rng = random.Random(2)
    item = [f"q{k}" for k in range(30)]
    short = ["tiny", "but", "still", "an", "item"]
    worn = [w if k % 6 else "swapped" for k, w in enumerate(item)]
    gone = [w if k % 2 else "swapped" for k, w in enumerate(item)]
    pad = lambda n: [rng.choice(FILL) for _ in range(n)]
    texts = [pad(50) + item + pad(20), pad(9) + worn + pad(9), pad(30) + gone + pad(5), pad(80), item[:12], item[20:], pad(3) + item[:7], pad(5) + short, short[:4], ["".join(short)], pad(4) + item + pad(4) + item]
    rows_ = [" ".join(t) for t in texts] + ["", None, " ".join(w.upper() + "!" for w in item)]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short)), (3, "too short"), (4, None), (5, ""), (1, " ".join(item))], ITEMS)
    return docs(spark, rows_).withColumn("item_id", d.F.lit(3)).withColumn("words", d.F.lit("x")), items


def test_leaks_with_replaced_words(spark):
    found, items = case(spark)
    got = rows(d.leaks(found, items), "doc_id", "item_id", "first_word", "matched_words")
    assert {(doc, item) for doc, item, *_ in got} == {(0, 1), (1, 1), (4, 1), (5, 1), (7, 2), (8, 2), (10, 1), (13, 1)}
    assert (0, 1, 50, 30) in got and (1, 1, 9, 25) in got and (5, 1, 0, 10) in got


def test_items_under_five_words_are_met_whole(spark):
    items = spark.createDataFrame([(1, "Paris"), (2, "forty two"), (3, "in the year"), (4, "who wrote the play"), (5, "so who wrote the play"), (6, "!")], ITEMS)
    found = docs(spark, ["it was Paris then", "forty or two", "Forty-two!", "back in the year one", "in that year", "and so who wrote the play", "who wrote a play", ""])
    want = [(0, 1, 1, 2, 1), (2, 2, 2, 0, 2), (3, 3, 3, 1, 3), (5, 4, 4, 2, 4), (5, 5, 5, 1, 5)]
    for seeds in (d.BROADCAST_SEEDS, 0):
        got = rows(d.leaks(found, items, broadcast_seeds=seeds), "doc_id", "item_id", "item_words", "first_word", "matched_words")
        assert got == want, got
    assert [r[0] for r in rows(d.clean(found, items), "doc_id")] == [1, 4, 6, 7]


def test_shuffled_seeds_find_the_same(spark):
    found, items = case(spark)
    cols = ("doc_id", "item_id", "item_words", "first_word", "matched_words")
    assert rows(d.leaks(found, items, broadcast_seeds=0), *cols) == rows(d.leaks(found, items), *cols)


def test_same_as_sql(spark, tmp_path):
    found, items = case(spark)
    folder = saved(tmp_path, documents=found.drop("item_id", "words"), benchmark=items.distinct())
    same_as_sql(d.op3_decontaminate(spark, folder), folder, sql.op3(), ["documents", "benchmark"])


def test_rows_without_ids_and_with_one_id(spark):
    item = " ".join(f"q{k}" for k in range(12))
    found = docs(spark, [(None, item), (None, "other words"), (4, f"see {item}"), (4, "clean text"), (5, None)])
    items = spark.createDataFrame([(1, item)], ITEMS)
    for seeds in (d.BROADCAST_SEEDS, 0):
        assert rows(d.leaks(found, items, broadcast_seeds=seeds), "doc_id", "item_id", "first_word") == [(4, 1, 1), (None, 1, 0)]
    assert rows(d.clean(found, items), "doc_id", "text") == [(4, "clean text"), (5, None), (None, "other words")]


def test_short_items_same_as_sql(spark, tmp_path):
    items = spark.createDataFrame([(1, "Paris"), (2, "forty two"), (3, "in the year"), (4, "who wrote the play"), (5, "so who wrote the play"), (6, "!")], ITEMS)
    found = docs(spark, ["it was Paris then", "forty or two", "Forty-two!", "back in the year one", "and so who wrote the play, Paris", ""])
    folder = saved(tmp_path, documents=found, benchmark=items)
    same_as_sql(d.op3_decontaminate(spark, folder), folder, sql.op3(), ["documents", "benchmark"])


@pytest.mark.parametrize("docs_empty", [True, False])
def test_empty_tables(spark, docs_empty):
    found, items = case(spark)
    assert d.leaks(found.limit(0) if docs_empty else found, items if docs_empty else items.limit(0)).count() == 0


def test_clean_keeps_the_rest_with_all_columns(spark):
    found, items = case(spark)
    kept = d.clean(found.drop("item_id", "words"), items)
    assert [r[0] for r in rows(kept, "doc_id")] == sorted([2, 3, 6, 9, 11, 12], key=lambda x: str((x,)))
    assert set(kept.columns) == {"doc_id", "text", "lang", "source", "n_chars"}


def by_hand(doc, item, window=10, share=0.8):
    """Whether some diagonal of the two has a window that agrees enough, from the definition."""
    size = min(len(item), window)
    for start in range(1 - len(item), len(doc)):
        same = [0 <= start + k < len(doc) and doc[start + k] == w for k, w in enumerate(item)]
        if len(item) >= d.MIN_WORDS and any(sum(same[k : k + size]) >= share * size for k in range(len(item) - size + 1)):
            return True
    return False


def test_no_overlap_is_missed(spark):
    rng = random.Random(8)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate([*range(4, 12), 20, 45])]
    texts = []
    for item in items:
        for _ in range(40):
            at = rng.randint(0, max(0, len(item) - 10))
            part = item[at : at + rng.randint(8, 12)]
            for k in rng.sample(range(len(part)), min(len(part), rng.randint(0, 3))):
                part = [*part[:k], "other", *part[k + 1 :]]
            cut = rng.choice([part, part[1:], part[:-1]])
            texts.append(rng.choice([[], ["before"] * 3]) + cut + rng.choice([[], ["after"] * 3]))
    table = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], ITEMS)
    got = rows(d.leaks(docs(spark, [" ".join(t) for t in texts]), table), "doc_id", "item_id")
    want = {(a, b) for a, t in enumerate(texts) for b, i in enumerate(items) if by_hand(t, i)}
    assert set(got) == want and 0 < len(want) < len(texts)


def test_repeated_words_meet_on_each_diagonal_once(spark, tmp_path, monkeypatch):
    """Texts of one word or one line again and again: the rows that SQL finds, and few diagonals."""
    frame = docs(spark, ["so " * 60, "so " * 9 + "it goes " + "so " * 9, "la li lu " * 20])
    items = spark.createDataFrame([(1, "so " * 20), (2, "la li lu " * 5), (3, "so so so")], "item_id bigint, text string")
    folder = saved(tmp_path, documents=frame, benchmark=items)
    same_as_sql(d.op3_decontaminate(spark, folder), folder, sql.op3(), ["documents", "benchmark"])
    many = []
    real = d.table_copy
    monkeypatch.setattr(d, "table_copy", lambda df, name: many.append((name, real(df, name))) or many[-1][1])
    words, item = 2000, 200
    (r,) = d.leaks(docs(spark, ["so " * words]), spark.createDataFrame([(1, "so " * item)], "item_id bigint, text string")).collect()
    assert (r.first_word, r.matched_words) == (0, item)
    assert dict(many)["diagonals"].count() <= words + item
