import random

import corpus_pipeline
from test_similar import brute_similar
from util import DOCS, saved

from recollect.llm import toxicity

WORDS = {"en": "the of and with thing other here where".split(), "fr": "le de être à nôtre chose où là".split()}


def corpus(spark):
    rng = random.Random(9)
    out, labels = [], []
    for k in range(240):
        lang = "fr" if k % 3 == 0 else "en"
        text = [rng.choice(WORDS[lang]) + rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(80)]
        bad = k % 8 == 1
        if bad:
            text[10:10] = ["dreadful"] * 6
        out.append((k, " ".join(text), lang, f"s{k % 4}", 1))
        labels.append((k, 1, int(bad)))
    item = [f"question{k}" for k in range(20)]
    plant = lambda i, text: out.append((i, text, "en", "s0", 1))
    plant(300, out[2][1])
    plant(301, out[4][1].upper())
    plant(302, " ".join(out[5][1].split()[:60] + item))
    plant(305, " ".join([*out[7][1].split()[:30], "another", *out[7][1].split()[31:]]))
    plant(303, "12 34 !!")
    plant(304, None)
    return spark.createDataFrame(out, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")


def test_stages_against_brute_force(spark, tmp_path):
    docs, labels, items = corpus(spark)
    folder = saved(tmp_path, documents=docs, labels=labels, benchmark=items)
    now = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == docs.columns
        now = corpus_pipeline.table_copy(after, f"t-{name}")
        kept[name] = {r.doc_id for r in now.collect()}
    every = {r.doc_id for r in docs.collect()}
    assert every - kept["language"] == {303, 304}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    gone = kept["language"] - kept["toxicity"]
    assert len(gone & toxic) >= 0.9 * len(toxic) and len(gone - toxic) <= 3
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(kept["toxicity"])
    assert kept["near_duplicates"] == set(brute_similar(ids, [texts[i] for i in ids]))
    assert {300, 301, 305} <= kept["toxicity"] - kept["near_duplicates"]
    assert kept["near_duplicates"] - kept["benchmark_leaks"] == {302}
    mixed = corpus_pipeline.STAGES[-1][1](spark, now, folder).collect()
    assert {r.doc_id for r in mixed} == kept["benchmark_leaks"] and abs(sum(r.taken for r in mixed) - sum(r.size for r in mixed)) < 300
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, run)) == sorted(map(str, mixed)) and toxicity.CUT == 0.3


def test_near_duplicates_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame(
        [(3, text, "en", "a", 1), (3, text, "en", "a", 1), (2, text.upper(), "en", None, None), (None, "alone here", None, None, None), (None, "alone here", None, None, None), (None, text, "en", "a", 1), (2, "its own text", "en", "a", 1)],
        DOCS,
    )
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    kept = sorted((str(r.doc_id), r.text) for r in found.collect())
    assert found.columns == docs.columns and kept == [("2", text.upper()), ("2", "its own text"), ("None", "alone here")]
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_stages_keep_columns_of_any_name_and_rows_that_share_an_id(spark, tmp_path):
    docs, labels, items = corpus(spark)
    folder = saved(tmp_path, documents=docs, labels=labels, benchmark=items)
    names = ["_id", "_lang", "_share", "_toxicity", "lang_pred", "score", "langs", "doc", "row", "row_more", "words", "found", "whole", "a.b"]
    odd = docs.where("doc_id < 40 or doc_id > 299").selectExpr("*", *[f"'keep' as `{n}`" for n in names])
    leak = odd.where("doc_id = 302")
    odd = odd.union(leak.selectExpr("2 as doc_id", *[f"`{c}`" for c in odd.columns[1:]])).union(leak.selectExpr("cast(null as bigint) as doc_id", *[f"`{c}`" for c in odd.columns[1:]]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        odd = corpus_pipeline.table_copy(stage(spark, odd, folder), f"odd-{name}")
        assert odd.columns == [*docs.columns, *names] and odd.select(*[f"`{n}`" for n in names]).distinct().collect() == [("keep",) * len(names)]
    kept = [(r.doc_id, r.text) for r in odd.collect()]
    item = items.first().text
    # The document 2 stays, the row of its id that holds the item goes, and so does the one without an id.
    assert [i for i, _ in kept].count(2) == 1 and not any(item in text for _, text in kept)
