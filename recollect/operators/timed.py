"""What an index knew at a time: BM25 with each question's own ``now``."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.bm25 import idf
from recollect.operators.bounded import SHARED, lifting
from recollect.sources.kept import kept


def totals_as_of(rows: DataFrame, probes: DataFrame, keys: list[str], ts: str, now: str, sums: dict[str, Column]) -> DataFrame:
    """The probes with the sums of the rows of their key whose ``ts`` is at or before their ``now``; 0 where there is none.

    Rows and probes never meet in a join: both are laid on one line of time, and running sums are read off
    where a probe stands. The line is cut into days: what earlier days sum to is one row for each day and
    key, and only rows of a probe's own day stand beside it, so a key with very many rows is in many
    groups. Rows without a time are never seen, and a probe without one sees nothing. Probes may repeat.
    """
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    names = list(sums)
    zero = [F.lit(0).cast("double").alias(c) for c in names]
    dated = rows.where(F.col(ts).isNotNull()).select(*keys, day(ts).alias("_day"), F.col(ts).alias("_at"), *[x.cast("double").alias(c) for c, x in sums.items()])
    asked = probes.select(*keys, day(now).alias("_day"), F.col(now).alias("_at")).where("_at is not null").distinct()
    by_day = dated.groupBy(*keys, "_day").agg(*[F.sum(c).alias(c) for c in names])
    days = by_day.select(*keys, "_day", F.lit(False).alias("_probe"), *names).unionByName(asked.select(*keys, "_day").distinct().select("*", F.lit(True).alias("_probe"), *zero))
    # A probe's row comes before its day's own.
    up_to = Window.partitionBy(*keys).orderBy("_day", F.col("_probe").desc()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = days.select(*keys, "_day", "_probe", *[F.sum(c).over(up_to).alias(f"_{c}") for c in names]).where("_probe").drop("_probe")
    beside = dated.join(asked.select(*keys, "_day").distinct(), [*keys, "_day"], "left_semi").select(*keys, "_day", "_at", F.lit(False).alias("_probe"), *names)
    line = beside.unionByName(asked.select(*keys, "_day", "_at", F.lit(True).alias("_probe"), *zero))
    within = Window.partitionBy(*keys, "_day").orderBy("_at", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    same_day = line.select(*keys, "_day", "_at", "_probe", *[F.sum(c).over(within).alias(c) for c in names]).where("_probe").drop("_probe")
    found = same_day.join(earlier, [*keys, "_day"]).select(*keys, F.col("_at").alias(now), *[(F.col(c) + F.col(f"_{c}")).alias(c) for c in names])
    out = probes.join(found, [*keys, now], "left")
    return out.select(*probes.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])


@dataclass(frozen=True)
class TimedIndex:
    """Postings and lengths with the time from which they are seen; a document's parts may come at several times."""

    postings: DataFrame  # history_id, doc_id, term, tf, ts
    lengths: DataFrame  # history_id, doc_id, dl, ts


def build(docs: DataFrame) -> TimedIndex:
    """The index of parts of documents (history_id, doc_id, ts, terms); a document is seen from its first part's time on."""
    postings = docs.select("history_id", "doc_id", "ts", F.explode("terms").alias("term")).groupBy("history_id", "doc_id", "term", "ts").agg(F.count("*").alias("tf"))
    lengths = docs.groupBy("history_id", "doc_id", "ts").agg(F.sum(F.size("terms")).alias("dl"))
    return TimedIndex(postings, lengths)


def scores(index: TimedIndex, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, history_id, doc_id, score) by what each query (qid, history_id, terms, now) could see at its ``now``.

    As ``bm25.scores`` of the parts with ts <= now alone: how many documents there are and have a term, their
    mean length, and a document's own length and counts are those of that time. The number and length of
    documents are running totals, read off for each query; no index is built for a time.
    """
    if k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"BM25 takes k1 >= 0 and b from 0 to 1, not {k1} and {b}")
    asked = queries.select("qid", "history_id", "now", F.explode(F.array_distinct("terms")).alias("term"))
    wanted = kept(index.postings.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi"), "wanted")
    first = wanted.groupBy("history_id", "term", "doc_id").agg(F.min("ts").alias("ts"))
    with_df = totals_as_of(first, asked, ["history_id", "term"], "ts", "now", {"df": F.lit(1)})
    began = index.lengths.groupBy("history_id", "doc_id").agg(F.min("ts").alias("ts"))
    probes = queries.select("history_id", "now").distinct()
    corpus = totals_as_of(began, probes, ["history_id"], "ts", "now", {"n": F.lit(1)}).join(totals_as_of(index.lengths, probes, ["history_id"], "ts", "now", {"total": F.col("dl")}), ["history_id", "now"])
    corpus = kept(corpus, "corpus")
    weighed = with_df.where("df > 0").join(corpus, ["history_id", "now"]).select("qid", "history_id", "now", "term", (F.col("total") / F.col("n")).alias("avgdl"), idf(F.col("n"), F.col("df")).alias("idf"))
    met = weighed.join(wanted, ["history_id", "term"]).where(F.col("ts") <= F.col("now"))
    met = kept(met.groupBy("qid", "history_id", "doc_id", "term", "now", "avgdl", "idf").agg(F.sum("tf").alias("tf")), "met")
    seen = met.select("history_id", "doc_id", "now").distinct()
    sized = totals_as_of(index.lengths.join(seen.select("history_id", "doc_id").distinct(), ["history_id", "doc_id"], "left_semi"), seen, ["history_id", "doc_id"], "ts", "now", {"dl": F.col("dl")})
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    return met.join(sized, ["history_id", "doc_id", "now"]).groupBy("qid", "history_id", "doc_id").agg(F.sum(F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("score"))


def _both_ends(df: DataFrame) -> DataFrame:
    """What holds is a running sum of beginnings less ends."""
    return df.withColumn("sign", F.lit(1)).unionByName(df.where("until is not null").withColumn("ts", F.col("until")).withColumn("sign", F.lit(-1)))


def _holds() -> Column:
    return (F.col("ts") <= F.col("now")) & (F.col("until").isNull() | (F.col("now") < F.col("until")))


def _weighed(held: DataFrame, postings: DataFrame, asked: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, history_id, now, term, avgdl, idf) of asked terms, by the rows that hold at now."""
    with_df = totals_as_of(_both_ends(postings), asked, ["history_id", "term"], "ts", "now", {"df": F.col("sign")})
    ends = _both_ends(held.select("history_id", "ts", "until", "dl"))
    corpus = kept(totals_as_of(ends, queries.select("history_id", "now").distinct(), ["history_id"], "ts", "now", {"n": F.col("sign"), "total": F.col("sign") * F.col("dl")}), "corpus")
    return with_df.where("df > 0").join(corpus, ["history_id", "now"]).select("qid", "history_id", "now", "term", (F.col("total") / F.col("n")).alias("avgdl"), idf(F.col("n"), F.col("df")).alias("idf"))


def interval_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, share: float = 0.0) -> DataFrame:
    """(qid, history_id, doc_id, score) over documents (history_id, doc_id, terms, ts, until) that each hold from ts until before ``until``.

    A query (qid, history_id, terms, now) sees those that hold at its now, and no statistic of others; null is no
    end. At a time at most one row of a doc_id may hold. What holds is a running sum of beginnings less ends.
    ``share`` (from 0 to 1): only scores that may reach that share of their query's best one, and all that do, the best among them; documents
    that share common terms alone with a query then are not met where a rare one decides.
    """
    if not 0 <= share <= 1:
        raise ValueError(f"a share is from 0 to 1, not {share}")
    asked = queries.select("qid", "history_id", "now", F.explode(F.array_distinct("terms")).alias("term"))
    held = docs.where("until is null or ts < until").select("history_id", "doc_id", "ts", "until", "terms", F.size("terms").alias("dl"))
    postings = held.select("history_id", "doc_id", "ts", "until", "dl", F.explode("terms").alias("term")).groupBy("history_id", "doc_id", "ts", "until", "dl", "term").agg(F.count("*").alias("tf"))
    wanted = kept(postings.join(asked.select("history_id", "term").distinct(), ["history_id", "term"], "left_semi"), "wanted")
    weighed = _weighed(held, wanted, asked, queries)
    holds = _holds()
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    if not share:
        met = weighed.join(wanted, ["history_id", "term"]).where(holds)
        return met.groupBy("qid", "history_id", "doc_id").agg(F.sum(weight).alias("score"))

    weighed = kept(weighed, "weighed")
    own = weighed.select("qid", "history_id", "now", "term", "avgdl", "idf")

    def summed(chosen: DataFrame) -> DataFrame:
        """The whole scores of chosen rows (qid, history_id, doc_id, ts)."""
        met = chosen.join(own, ["qid", "history_id"]).join(wanted, ["history_id", "doc_id", "ts", "term"])
        return met.groupBy("qid", "history_id", "doc_id").agg(F.sum(weight).alias("score"))

    def holding(terms: DataFrame) -> DataFrame:
        """Rows that hold at their query's now and have one of its given terms (qid, history_id, now, term)."""
        return terms.join(wanted, ["history_id", "term"]).where(holds).select("qid", "history_id", "doc_id", "ts").distinct()

    # What has the query's rarest term is scored first: the best of it is no more than the best of all.
    rarest = weighed.groupBy("qid", "history_id").agg(F.max_by(F.struct("now", "term"), F.struct("idf", "term")).alias("r")).select("qid", "history_id", "r.*")
    floor = summed(holding(rarest)).groupBy("qid").agg((F.max("score") * share).alias("floor"))
    # A term weighs most in the shortest document of each count; terms that together with all of lesser weight stay below the floor bring no document about.
    shapes = wanted.groupBy("history_id", "term", "tf").agg(F.min("dl").alias("dl")).groupBy("history_id", "term").agg(F.collect_list(F.struct("tf", "dl")).alias("shapes"))
    most = F.array_max(F.transform("shapes", lambda s: s["tf"] * (k1 + 1) / (s["tf"] + k1 * (1 - b + b * s["dl"] / F.col("avgdl")))))
    bounds = weighed.join(shapes, ["history_id", "term"]).join(floor, "qid").withColumn("top", F.col("idf") * most)
    telling = lifting(bounds, "qid").select("qid", "history_id", "now", "term")
    return summed(holding(telling))


def interval_best(docs: DataFrame, queries: DataFrame, share: float, most: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, history_id, doc_id, began, score, rank): for each query the first ``most`` of what ``interval_scores`` finds with ``share``.

    Documents also have ``began``, one for all rows of a doc_id, and ``dl``; ties go by began and doc_id. Of their terms only those that are asked for need be there.
    """
    if not 0 <= share <= 1 or most < 1 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError(f"BM25 takes k1 >= 0, b and a share from 0 to 1, and a positive number of hits, not {k1}, {b}, {share} and {most}")
    found = likely(docs, queries, most, k1, b).withColumn("top", F.max("score").over(Window.partitionBy("qid"))).where(F.col("score") >= share * F.col("top"))
    ranked = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "began", "doc_id")
    return found.drop("top").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)


def likely(docs: DataFrame, queries: DataFrame, most: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, history_id, doc_id, began, score): the first ``most`` of each query, among few others.

    A document with a term of the query that fewer than SHARED queries have is met by that term. What the others
    score is the same for all queries of one now and the same common terms, so their first ones are found once.
    """
    asked = kept(queries.select("qid", "history_id", "now", F.explode(F.array_distinct("terms")).alias("term")), "terms")
    popular = kept(asked.groupBy("history_id", "term").agg((F.count("*") >= SHARED).alias("common")), "popular")
    counted = F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda x: x == t)).alias("tf")))
    rows = kept(docs.where("until is null or ts < until").select("history_id", "doc_id", "began", "ts", "until", "dl", counted.alias("words")), "rows")
    postings = rows.select("history_id", "ts", "until", F.explode("words.term").alias("term")).join(popular.select("history_id", "term"), ["history_id", "term"], "left_semi")
    weighed = kept(_weighed(rows, postings, asked, queries).join(popular, ["history_id", "term"]), "weighed")
    word = F.struct("term", "idf")
    asking = weighed.groupBy("qid", "history_id", "now", "avgdl").agg(F.sort_array(F.collect_list(word)).alias("own"), F.sort_array(F.collect_list(F.when(F.col("common"), word))).alias("shared"))
    asking = kept(asking.withColumn("alike", F.to_json("shared.term")), "asking")

    rare = rows.select("*", F.explode("words.term").alias("term")).join(weighed.where("not common").select("qid", "history_id", "now", "term"), ["history_id", "term"])
    rare = rare.where(_holds()).drop("now").dropDuplicates(["qid", "history_id", "doc_id"]).join(asking, ["qid", "history_id"])
    rare = rare.select("qid", "history_id", "doc_id", "began", _score("own", k1, b).alias("score"))

    probes = asking.where(F.size("shared") > 0).select("history_id", "now", "avgdl", "shared", "alike").distinct()
    first = _first_of_common(rows, popular.where("common").select("history_id", "term"), probes, most, k1, b)
    others = asking.select("qid", "history_id", "now", "alike").join(first, ["history_id", "now", "alike"]).select(*rare.columns)
    return rare.unionByName(others).groupBy("qid", "history_id", "doc_id", "began").agg(F.max("score").alias("score"))


def _score(terms: str, k1: float, b: float) -> Column:
    """The score of ``words`` in a row of length ``dl`` by the given (term, idf), added up in order of terms."""
    norm = k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))
    met = F.transform(terms, lambda a: F.struct(a["idf"].alias("idf"), F.get(F.filter("words", lambda w: w["term"] == a["term"]), F.lit(0))["tf"].alias("tf")))
    met = F.filter(met, lambda x: x["tf"].isNotNull())
    return F.aggregate(met, F.lit(0.0), lambda total, x: total + x["idf"] * x["tf"] * (k1 + 1) / (x["tf"] + norm))


#: The nodes of a binary tree over the places from lo until before hi that together cover these and no others: two of a level at most.
_COVER = """flatten(transform(sequence(0, 40), j -> filter(array(
    if(shiftright(lo + shiftleft(1L, j) - 1, j) < shiftright(hi, j) and shiftright(lo + shiftleft(1L, j) - 1, j) % 2 = 1, struct(j as level, shiftright(lo + shiftleft(1L, j) - 1, j) as node), null),
    if(shiftright(lo + shiftleft(1L, j) - 1, j) < shiftright(hi, j) and shiftright(hi, j) % 2 = 1, struct(j as level, shiftright(hi, j) - 1 as node), null)), x -> x is not null)))"""


def _first_of_common(rows: DataFrame, common: DataFrame, probes: DataFrame, most: int, k1: float, b: float) -> DataFrame:
    """(history_id, now, alike, doc_id, began, score): the first ``most`` of the rows that hold at each probe's now, by its common terms alone.

    Rows of the same common words and length are of one kind: they score alike, and its oldest go on. Times asked for are places
    of a binary tree, and a row stands at the few nodes that cover the places where it holds; a node keeps the oldest of each
    kind, and a probe looks at the nodes above its place. So neither rows nor probes meet all of the other.
    """
    key = ["history_id", "doc_id"]
    words = rows.select("history_id", "doc_id", "began", "ts", "until", "dl", F.explode("words").alias("word")).select("*", "word.*").drop("word").join(common, ["history_id", "term"])
    # One shuffle by document serves both the words of a row and the rows in time.
    kinds = words.repartition(*key).groupBy(*key, "began", "ts", "until", "dl").agg(F.sort_array(F.collect_list(F.struct("term", "tf"))).alias("words"))
    kinds = kinds.withColumn("kind", F.sha2(F.to_json(F.struct("dl", "words")), 256))
    # Rows that follow one another in the same kind are one span.
    in_time = Window.partitionBy(*key).orderBy("ts")
    new = F.coalesce((F.lag("kind").over(in_time) != F.col("kind")) | (F.lag("until").over(in_time) < F.col("ts")), F.lit(True))
    spans = kinds.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(in_time)).groupBy(*key, "began", "kind", "dl", "words", "span")
    open_end = F.max(F.col("until").isNull())
    spans = kept(spans.agg(F.min("ts").alias("ts"), F.when(~open_end, F.max("until")).alias("until")).drop("span"), "spans")

    times = kept(probes.select("history_id", F.col("now").alias("time")).distinct(), "times")
    before = lambda c: F.col(c) - F.expr("INTERVAL '0.000001' SECOND")
    ends = spans.select("history_id", F.col("ts").alias("end")).unionByName(spans.where("until is not null").select("history_id", F.col("until").alias("end"))).distinct()
    places = totals_as_of(times, ends.withColumn("before", before("end")), ["history_id"], "time", "before", {"place": F.lit(1)}).select("history_id", "end", F.col("place").cast("bigint").alias("place"))
    places = kept(places, "places")
    many = times.groupBy("history_id").agg(F.count("*").alias("many"))
    laid = spans.join(places.select("history_id", F.col("end").alias("ts"), F.col("place").alias("lo")), ["history_id", "ts"])
    laid = laid.join(places.select("history_id", F.col("end").alias("until"), F.col("place").alias("hi")), ["history_id", "until"], "left").join(many, "history_id").withColumn("hi", F.coalesce("hi", "many")).where("lo < hi")
    oldest = Window.partitionBy("history_id", "level", "node", "kind").orderBy("began", "doc_id")
    nodes = laid.select("history_id", "doc_id", "began", "kind", "dl", "words", F.inline(F.expr(_COVER)))
    nodes = kept(nodes.withColumn("nth", F.row_number().over(oldest)).where(F.col("nth") <= most).drop("nth"), "nodes")

    at = totals_as_of(times, times.withColumnRenamed("time", "now"), ["history_id"], "time", "now", {"place": F.lit(1)}).withColumn("place", F.col("place").cast("bigint") - 1)
    above = probes.join(at, ["history_id", "now"]).select("*", F.posexplode(F.expr("transform(sequence(0, 40), j -> shiftright(place, j))")).alias("level", "node"))
    met = above.join(nodes, ["history_id", "level", "node"]).select("history_id", "now", "alike", "doc_id", "began", _score("shared", k1, b).alias("score")).where("score > 0")
    ranked = Window.partitionBy("history_id", "now", "alike").orderBy(F.round("score", 12).desc(), "began", "doc_id")
    return met.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= most).drop("nth")
