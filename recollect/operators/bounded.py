"""The best hits of BM25 by bounds of blocks: documents that cannot enter the result are not scored.

Documents lie in blocks of a history. Beside the weight of each posting the index has the largest weight of each
term in a block, and in the history. A lower bound of a question's k-th best score comes from the k heaviest
postings of each of its terms, added up by document. What follows are three sieves, each exact: terms that
together stay below the bound bring no block about; a block whose largest weights stay below it is left out;
and in a block that is left, only documents with one of the terms that can lift them to the bound are scored.
What terms reach together is the sum of their largest weights, or where many questions share them the best
score of one document. Documents with the same asked words and length can be searched as one (``alike``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators import bm25
from recollect.sources.kept import kept

#: Documents of a block, about, where the caller names no blocks.
BLOCK = 64
#: Weights are added up in any order, and ``bm25.ranked`` takes scores alike to 12 places as tied.
RELATIVE, ABSOLUTE = 1e-9, 1e-11
#: So many questions share terms whose best score together is worth finding.
SHARED = 64


@dataclass(frozen=True)
class BlockIndex:
    weights: DataFrame  # history_id, block, doc_id, term, w
    tops: DataFrame  # history_id, block, term, top


def alike(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """Documents (history_id, doc_id, terms) that have an asked word, with the kind of each: (history_id, doc_id, kind, dl, words).

    words are the asked (history_id, term) ones among its terms, with their counts. Documents of a kind have the same words and
    length, so every question scores them alike.
    """
    postings = bm25.build(docs).postings.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi")
    words = postings.groupBy("history_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("words"))
    sized = words.join(docs.select("history_id", "doc_id", F.size("terms").alias("dl")), ["history_id", "doc_id"])
    return kept(sized.select("history_id", "doc_id", F.sha2(F.to_json(F.struct("dl", "words")), 256).alias("kind"), "dl", "words"), "kinds").hint("merge")


def build_alike(docs: DataFrame, kinds: DataFrame, k1: float = 1.2, b: float = 0.75) -> BlockIndex:
    """The index of the kinds of documents that ``alike`` finds, each as one document; statistics stay those of all documents."""
    _checked(k1, b)
    one = kinds.groupBy("history_id", "kind", "dl").agg(F.count("*").alias("copies"), F.first("words").alias("words"))
    one = kept(one.withColumn("level", F.floor(8 * F.log2(F.col("dl") + F.lit(1.0)))), "kind-words").hint("merge")
    sizes = one.groupBy("history_id", "level").agg(F.count("*").alias("at_level"))
    block = F.concat_ws("-", "level", F.pmod(F.xxhash64("kind"), F.ceil(F.col("at_level") / BLOCK)))
    places = one.join(sizes, ["history_id", "level"]).join(bm25.build(docs).corpus, "history_id")
    places = places.select("history_id", F.col("kind").alias("doc_id"), block.alias("block"), "dl", "n", "avgdl", "copies", F.inline("words"))
    df = places.groupBy("history_id", "term").agg(F.sum("copies").alias("df"))
    return _written(places.join(df, ["history_id", "term"]), k1, b)


def _checked(k1: float, b: float) -> None:
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"BM25 takes k1 >= 0 and b from 0 to 1, not {k1} and {b}")


def _written(postings: DataFrame, k1: float, b: float) -> BlockIndex:
    """The index of (history_id, block, doc_id, term, tf, df, dl, n, avgdl). Its files are many times smaller than its
    rows, so it is joined by merging: by the files' size Spark would send it through the driver."""
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    weight = bm25.idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    weights = kept(postings.select("history_id", "block", "doc_id", "term", weight.alias("w")), "weights").hint("merge")
    return BlockIndex(weights, kept(weights.groupBy("history_id", "block", "term").agg(F.max("w").alias("top")), "tops").hint("merge"))


def build(docs: DataFrame, asked: DataFrame | None = None, block: Column | None = None, k1: float = 1.2, b: float = 0.75) -> BlockIndex:
    """The index of documents (history_id, doc_id, terms), written once.

    ``block`` is an expression over their columns; documents that share words, as those of a session do, are best
    kept together. Without it documents of about one length lie together, as a short one weighs each word more, and a
    hash deals them out to blocks of some BLOCK. ``asked`` (history_id, term) narrows the index to those
    terms, for questions that are known before; statistics stay those of all documents.
    """
    _checked(k1, b)
    index = bm25.build(docs)
    places = docs.select(*docs.columns, F.floor(8 * F.log2(F.size("terms") + F.lit(1.0))).alias("level"))
    if block is None:
        sizes = places.groupBy("history_id", "level").agg(F.count("*").alias("at_level"))
        places = places.join(sizes, ["history_id", "level"])
        block = F.concat_ws("-", "level", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("at_level") / BLOCK)))
    places = places.join(index.corpus, "history_id").select("history_id", "doc_id", block.cast("string").alias("block"), F.size("terms").alias("dl"), "n", "avgdl")
    postings = index.postings
    if asked is not None:
        postings = postings.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi")
    df = postings.groupBy("history_id", "term").agg(F.count("*").alias("df"))
    return _written(postings.join(df, ["history_id", "term"]).join(places, ["history_id", "doc_id"]), k1, b)


def distinct_terms(queries: DataFrame) -> DataFrame:
    """(qid, history_id, term) of questions (qid, history_id, terms); a repeated term counts once."""
    return queries.select("qid", "history_id", F.explode(F.array_distinct("terms")).alias("term"))


def floors(index: BlockIndex, asked: DataFrame, k: int) -> DataFrame:
    """(qid, floor): no more than the question's k-th best score; questions with fewer than k heavy postings have no row.

    The k heaviest postings of a term are found once for all questions that have it. The k documents for which they
    add up to most are scored in full: the least of k scores is no more than the k-th best.
    """
    heavy = Window.partitionBy("history_id", "term").orderBy(F.col("w").desc(), "doc_id")
    first = index.weights.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi").withColumn("nth", F.row_number().over(heavy)).where(F.col("nth") <= k)
    partial = asked.join(first, ["history_id", "term"]).groupBy("qid", "history_id", "doc_id").agg(F.sum("w").alias("part"))
    likely = Window.partitionBy("qid").orderBy(F.col("part").desc(), "doc_id")
    chosen = partial.withColumn("nth", F.row_number().over(likely)).where(F.col("nth") <= k).select("qid", "history_id", "doc_id")
    scored = chosen.join(asked, ["qid", "history_id"]).join(index.weights, ["history_id", "doc_id", "term"]).groupBy("qid", "doc_id").agg(F.sum("w").alias("score"))
    return scored.groupBy("qid").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") == k).select("qid", "floor")


def _reaching() -> Column:
    return F.col("reach") >= F.col("floor") * (1 - RELATIVE) - ABSOLUTE


def lifting(rows: DataFrame, *by: str, given: Column | None = None) -> DataFrame:
    """Of the terms of each group, those that, with all of lesser weight and what is given, may reach the floor."""
    up_to = Window.partitionBy(*by).orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.sum("top").over(up_to)
    return rows.withColumn("reach", reach if given is None else given + reach).where(_reaching())


def judged(index: BlockIndex, wanted: DataFrame) -> DataFrame:
    """The terms (qid, history_id, term, floor) that occur, and whether each ``tells``: a document that may reach the floor has one that does.

    As ``lifting``, but terms with all of lesser weight, where SHARED questions have the same, reach what the best document
    of theirs scores: two common words that never stand together tell nothing. ``others``: what a question's terms that do not tell can reach together.
    """
    largest = index.tops.groupBy("history_id", "term").agg(F.max("top").alias("top"))
    up_to = Window.partitionBy("qid").orderBy("top", "term").rowsBetween(Window.unboundedPreceding, 0)
    met = wanted.join(largest, ["history_id", "term"])
    met = kept(met.select("qid", "history_id", "term", "floor", F.sum("top").over(up_to).alias("reach"), F.collect_list("term").over(up_to).alias("terms")), "reach")
    many = met.where(_reaching()).groupBy("history_id", "terms").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
    sums = many.select("history_id", "terms", F.explode("terms").alias("term")).join(index.weights, ["history_id", "term"]).groupBy("history_id", "terms", "doc_id").agg(F.sum("w").alias("w"))
    best = sums.groupBy("history_id", "terms").agg(F.max("w").alias("best"))
    found = met.join(best, ["history_id", "terms"], "left").withColumn("reach", F.coalesce("best", "reach"))
    found = found.withColumn("tells", _reaching())
    last = F.max(F.when(~F.col("tells"), F.struct(F.size("terms").alias("n"), "reach"))).over(Window.partitionBy("qid"))
    return kept(found.select("qid", "history_id", "term", "floor", "tells", F.coalesce(last["reach"], F.lit(0.0)).alias("others")), "judged").hint("merge")


def candidates(index: BlockIndex, asked: DataFrame, floor: DataFrame) -> DataFrame:
    """(qid, history_id, block, doc_id): every document whose score may reach its question's floor."""
    # Few terms meet many blocks: as many tasks as Spark is told to use, however small their input.
    spread = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = judged(index, asked.join(floor, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))))
    blocks = wanted.where("tells").select("qid", "history_id", "term").repartition(spread, "history_id", "term").join(index.tops, ["history_id", "term"]).select("qid", "history_id", "block").distinct()
    in_block = blocks.join(wanted, ["qid", "history_id"]).join(index.tops, ["history_id", "block", "term"])
    low = F.coalesce(F.sum(F.when(~F.col("tells"), F.col("top"))).over(Window.partitionBy("qid", "block")), F.lit(0.0))
    able = lifting(in_block.withColumn("low", F.least("others", low)).where("tells"), "qid", "block", given=F.col("low")).select("qid", "history_id", "block", "term")
    return able.join(index.weights, ["history_id", "block", "term"]).select("qid", "history_id", "block", "doc_id").distinct()


def _scored(index: BlockIndex, asked: DataFrame, floor: DataFrame) -> DataFrame:
    """Weights are added up as decimals, whose sum no order changes: documents of equal weights tie, wherever their rows meet."""
    met = candidates(index, asked, floor).join(asked, ["qid", "history_id"]).join(index.weights, ["history_id", "block", "doc_id", "term"])
    return met.groupBy("qid", "history_id", "doc_id").agg(F.sum(F.col("w").cast("decimal(30,18)")).cast("double").alias("score"))


def best(index: BlockIndex, queries: DataFrame, k: int) -> DataFrame:
    """(qid, history_id, doc_id, score): the k best documents of each question and all that tie with the last,
    among few others; ``bm25.ranked`` with the same k gives what it gives over all scores."""
    if k < 1:
        raise ValueError(f"the number of hits is positive, not {k}")
    asked = distinct_terms(queries)
    return _scored(index, asked, kept(floors(index, asked, k), "floors"))


def strong(index: BlockIndex, queries: DataFrame, share: float, most: int | None = None) -> DataFrame:
    """The scores that may reach ``share`` of their question's best one (from 0 to 1), and all that do.

    ``most``: only as many are wanted, and all that tie with the last of them; the best one is always there.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"a share is from 0 to 1, not {share}")
    asked = distinct_terms(queries)
    floor = floors(index, asked, 1).withColumn("floor", F.col("floor") * share)
    if most is not None:
        floor = floor.unionByName(floors(index, asked, most)).groupBy("qid").agg(F.max("floor").alias("floor"))
    return _scored(index, asked, kept(floor, "floors"))
