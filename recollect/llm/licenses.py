"""License scans: phrases at their places, and an exact set-similarity join with templates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import NOT_WORD, inline_table, lower_ascii, read, split_words

#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices that the set-similarity join looks for, with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
]
#: Containment that a block must reach; words of a block, of which the next starts at half.
THRESHOLD, WINDOW = 0.9, 64


def _places(words: Column, phrase: str) -> Column:
    """The starts of a phrase in an array of words."""
    want = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.size(words) - len(want))

    def here(i: Column) -> Column:
        same = F.lit(True)
        for k, w in enumerate(want):
            same &= F.get(words, i + k) == w
        return same

    return F.filter(starts, here)


def template_tokens(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """(template, label, token, size, need): a template's distinct words, and how many must be met."""
    rows = []
    for k, (label, text) in enumerate(templates):
        words = sorted(set(text.split()))
        need = math.ceil(threshold * len(words) - 1e-9)
        rows += [{"template": k, "label": label, "token": w, "size": len(words), "need": need} for w in words]
    return inline_table(spark, rows, "template int, label string, token string, size int, need int")


def similar_blocks(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, window: int | None = None) -> DataFrame:
    """(row, block, template, label, contained) for every block meeting a template's threshold.

    ``texts`` has (row, words). A block is a window of words, WINDOW or twice the longest template's;
    the next one starts half a window later, so a notice lies whole in some block wherever it starts. Tokens
    of the templates are ordered by their frequency in all texts, rarest first. A block with
    enough of a template's tokens has one of its first size - need + 1 in that order (prefix
    filter), at a place that leaves need tokens in the template (positional filter: the cut of the
    prefix); and the block has at least need words (length filter). Those left are compared as sets, so the result is exact.
    The templates are a parameter of the call, a few hundred tokens, and are broadcast.
    """
    tokens = template_tokens(texts.sparkSession, templates, threshold)
    window = window or max(WINDOW, 2 * max((len(t.split()) for _, t in templates), default=0))
    half = window // 2
    word = texts.select("row", "words", F.posexplode("words").alias("pos", "token"))
    known = word.select("token").join(F.broadcast(tokens.select("token").distinct()), "token").groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(F.broadcast(known), "token", "left").select("template", "size", "need", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token").alias("t"))
    lists = ordered.groupBy("template", "size", "need").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    lists = lists.select("template", "size", "need", F.col("ts.token").alias("ordered"))
    prefix = lists.select("template", "size", "need", "ordered", F.explode(F.slice("ordered", F.lit(1), F.col("size") - F.col("need") + 1)).alias("token"))
    met = word.join(F.broadcast(prefix), "token")
    block = F.explode(F.array(F.floor(F.col("pos") / half), F.floor(F.col("pos") / half) - 1))
    placed = met.select("row", "template", "size", "need", "ordered", "words", block.alias("block")).where("block >= 0")
    content = placed.select("row", "block", "template", "size", "need", "ordered", F.slice("words", (F.col("block") * half + 1).cast("int"), F.lit(window)).alias("content"))
    able = content.where(F.size("content") >= F.col("need"))
    contained = F.size(F.array_intersect("ordered", "content"))
    held = able.withColumn("overlap", contained).where(F.col("overlap") >= F.col("need"))
    best = held.groupBy("row", "block", "template").agg((F.max("overlap") / F.max("size")).alias("contained"))
    labels = tokens.select("template", "label").distinct()
    return best.join(F.broadcast(labels), "template").select("row", "block", "template", "label", "contained")


def scanned(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every document.

    n_base counts all places of the phrases, first_word and last_word are the least and largest
    start (words from 0), null without one. base_labels are the phrases' labels; labels add those
    of the templates that some block meets; both are distinct, sorted and joined by commas. score
    is the best containment of a template, 1 where a phrase stands, else 0. Null and empty texts
    have no words, places or labels. Rows with equal ids have the labels of their own texts.
    Extra columns are ignored; no rows give no rows.
    """
    # Two hashes, as one would bring some of many billions of rows together; of the text, which is read at once.
    row = F.struct(F.xxhash64(id_col, text).alias("a"), F.xxhash64(F.lit(1), text, id_col).alias("b"))
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), split_words(lower_ascii(F.col(text)), NOT_WORD).alias("words"), row.alias("row"))
    found = similar_blocks(own.select("row", "words"), templates, threshold).groupBy("row").agg(F.collect_set("label").alias("more"), F.max("contained").alias("contained"))
    line = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    based = own.withColumn("line", line)
    places = {p: F.when(F.contains("line", F.lit(f" {p} ")), _places(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for p in phrases}
    based = based.select("doc_id", "row", F.size("words").cast("bigint").alias("n_words"), *[c.alias(f"p{k}") for k, c in enumerate(places.values())])
    every = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    labelled = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(v)) for k, v in enumerate(phrases.values())]))
    based = based.select("doc_id", "row", "n_words", every.alias("every"), F.array_distinct(labelled).alias("base"))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return based.join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size("every").cast("bigint").alias("n_base"),
        F.array_min("every").cast("bigint").alias("first_word"),
        F.array_max("every").cast("bigint").alias("last_word"),
        F.array_join(F.sort_array("base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("base", more)), ",").alias("labels"),
        F.when(F.size("every") > 0, 1.0).otherwise(F.coalesce("contained", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license phrases and notices, as ``scanned`` finds them."""
    return scanned(read(spark, sf_dir, "documents"))
