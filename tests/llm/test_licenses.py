import random

from util import docs, rows, same_as_sql, saved

from recollect.llm import licenses as li
from recollect.llm import sql

TEXTS = [
    "Released under the MIT License.", "under the mit\nlicense under the MIT-license", "under the mit", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and apache license version 2",
    "All rights reserved.", "reserved all the rights", "rights reserved", "", None, "  \n", "Ünder the mit license", "unde\u0300r the mit license", "You can redistribute it and/or modify it under the terms of the GNU General Public License",
    "This work is licensed under the GNU General Public License, version 2.", "x " * 500 + "licensed under cc by nc 4 0 " + "y " * 31 + "all rights reserved", "mit license apache license version 2 apache license version 2",
]


def test_same_as_sql(spark, tmp_path):
    rng = random.Random(6)
    words = "under the mit license apache version 2 cc by nc all rights reserved x y z".split()
    texts = TEXTS + [" ".join(rng.choice(words) for _ in range(rng.choice([5, 40, 200]))) for _ in range(60)]
    folder = saved(tmp_path, documents=docs(spark, [*texts, texts[0]]))
    same_as_sql(li.op9_license_scan(spark, folder), folder, sql.op9(), ["documents"])


def test_contract_by_hand(spark):
    df = docs(spark, TEXTS).selectExpr("*", "'x' as label", "1 as row", "'y' as words", "2 as pos")
    got = {r.doc_id: r for r in li.scanned(df).collect()}
    said = lambda k: (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels, got[k].labels)
    assert said(0) == (5, 1, 1, 1, "mit", "mit") and said(1) == (8, 2, 0, 4, "mit", "mit") and said(2) == (3, 0, None, None, "", "")
    assert said(3) == (8, 1, 3, 3, "apache-2", "apache-2") and said(4)[1:5] == (2, 0, 6, "apache-2,cc-by-nc")
    assert said(5)[4:] == ("", "all-rights-reserved") and said(6)[5] == "all-rights-reserved" and said(7)[5] == ""
    assert said(8) == said(9) == said(10) == (0, 0, None, None, "", "") and said(11)[1] == 0
    assert said(13)[5] == "gpl" and said(14)[5] == "gpl" and got[14].score >= 0.9 and said(15)[4:] == ("cc-by-nc", "all-rights-reserved,cc-by-nc")
    assert got[0].score == 1.0 and got[7].score == 0.0


def test_blocks_are_those_of_brute_force(spark):
    rng = random.Random(8)
    templates = [("a", "a b c d e"), ("b", "c d e f g h i j"), ("c", "z")]
    vocabulary = list("abcdefghijz") + [f"n{k}" for k in range(30)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([1, 9, 50]))] for _ in range(50)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "row bigint, words array<string>")
    got = {(r, b, t) for r, b, t in rows(li.similar_blocks(df, templates, 0.6, 8), "row", "block", "template")}
    want = set()
    for r, t in enumerate(texts):
        for b in range(0, (len(t) - 1) // 4 + 1):
            for k, (_, line) in enumerate(templates):
                tokens = set(line.split())
                if len(tokens & set(t[b * 4 : b * 4 + 8])) >= 0.6 * len(tokens):
                    want.add((r, b, k))
    assert got == want


def test_no_rows(spark):
    assert li.scanned(docs(spark, ["x"]).limit(0)).count() == 0
