"""Reports over evaluation rows: rollups, paired differences, positions, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.temporal import query_window
from recollect.functions.text import count_tokens
from recollect.operators import evaluation
from recollect.operators.stats import cluster_means

ALL = "all types"
METRICS = ("recall", "recall_strict", "all", "session_recall", "all_sessions", "newest", "stale_only")


def _typed(rows: DataFrame) -> DataFrame:
    """Each row under its own type and under all types."""
    return rows.withColumn("qtype", F.explode(F.array(F.col("qtype"), F.lit(ALL))))


def summarise(rows: DataFrame, axis: str = "budget") -> DataFrame:
    """(dataset, split, strategy, axis, qtype, n_questions, mean_tokens, n_measurable): one pass of grouping sets."""
    by = ["dataset", "split", "strategy", axis]
    out = rows.groupingSets([[*map(F.col, by), F.col("qtype")], [*map(F.col, by)]], *by, "qtype").agg(F.grouping("qtype").alias("_all"), F.count("*").alias("n_questions"), F.round(F.avg("tokens"), 1).alias("mean_tokens"), F.count_if("measurable").alias("n_measurable"))
    return out.withColumn("qtype", F.when(F.col("_all") == 1, F.lit(ALL)).otherwise(F.col("qtype"))).drop("_all")


def metric_means(rows: DataFrame, axis: str = "budget", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(dataset, split, strategy, axis, qtype, metric, mean, lo, hi, n, clusters) of measurable rows.

    The metrics are unpivoted, so all of them share two aggregations.
    """
    long = rows.where("measurable").select("dataset", "split", "strategy", axis, "qtype", "cluster", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m"))
    long = _typed(long.select("dataset", "split", "strategy", axis, "qtype", "cluster", "m.metric", "m.value"))
    means = cluster_means(long, ["dataset", "split", "strategy", axis, "qtype", "metric"])
    return means.select("dataset", "split", "strategy", axis, "qtype", "metric", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "n", "clusters")


def compare(rows: DataFrame, a: str, b: str, value: int, split: str = "test", metric: str = "recall", axis: str = "budget") -> DataFrame:
    """(dataset, qtype, mean, lo, hi, n, clusters) of a - b on the questions that both were scored on."""
    own = rows.where((F.col(axis) == value) & (F.col("split") == split) & F.col("strategy").isin(a, b) & F.col("measurable") & F.col(metric).isNotNull())
    side = lambda name: F.max(F.when(F.col("strategy") == name, F.col(metric).cast("double")))
    pairs = own.groupBy("dataset", "qid", "qtype", "cluster").agg(side(a).alias("x"), side(b).alias("y"))
    pairs = _typed(pairs.withColumn("value", F.col("x") - F.col("y")))
    means = cluster_means(pairs, ["dataset", "qtype"])
    return means.select("dataset", "qtype", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "n", "clusters")


def budget_to_reach(means: DataFrame, target: float) -> DataFrame:
    """(dataset, split, strategy, qtype, budget): the least budget with a mean recall of ``target``, null for none."""
    own = means.where("metric = 'recall'")
    return own.groupBy("dataset", "split", "strategy", "qtype").agg(F.min(F.when(F.col("mean") >= target, F.col("budget"))).alias("budget"))


def bucket(pos: Column) -> Column:
    """The part of the history that a position falls in, finer towards the end."""
    return F.when(pos < 0, None).when(pos < 0.25, "0-0.25").when(pos < 0.5, "0.25-0.5").when(pos < 0.75, "0.5-0.75").when(pos < 0.9, "0.75-0.9").when(pos < 1.0001, "0.9-1")


def by_position(evidence_rows: DataFrame, budget: int, split: str = "test") -> DataFrame:
    """(dataset, strategy, position, mean, lo, hi, n, clusters) of finding gold turns, by where they stand.

    ``evidence_rows`` has (dataset, split, strategy, budget, qid, cluster, turn_id, pos, hit, whole).
    """
    own = evidence_rows.where((F.col("budget") == budget) & (F.col("split") == split)).withColumn("position", bucket(F.col("pos"))).where("position is not null")
    means = cluster_means(own.withColumn("value", F.col("hit").cast("double")), ["dataset", "strategy", "position"])
    return means.select("dataset", "strategy", "position", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "n", "clusters")


def position_differences(evidence_rows: DataFrame, a: str, b: str, budget: int, split: str = "test") -> DataFrame:
    """(dataset, position, credit, mean, lo, hi, n, clusters) of a - b on each gold turn.

    Lenient credit counts a cut turn as found, strict credit does not.
    """
    own = evidence_rows.where((F.col("budget") == budget) & (F.col("split") == split) & F.col("strategy").isin(a, b)).withColumn("position", bucket(F.col("pos"))).where("position is not null")
    credits = own.select("*", F.explode(F.array(F.struct(F.lit("lenient").alias("credit"), F.col("hit").alias("got")), F.struct(F.lit("strict").alias("credit"), F.col("whole").alias("got")))).alias("c"))
    side = lambda name: F.max(F.when(F.col("strategy") == name, F.col("c.got").cast("double")))
    pairs = credits.groupBy("dataset", "position", "cluster", "qid", "turn_id", F.col("c.credit").alias("credit")).agg(side(a).alias("x"), side(b).alias("y"))
    means = cluster_means(pairs.withColumn("value", F.col("x") - F.col("y")), ["dataset", "position", "credit"])
    return means.select("dataset", "position", "credit", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "n", "clusters")


def summarise_answers(rows: DataFrame) -> DataFrame:
    """(dataset, strategy, qtype, n, unparsed, mean, lo, hi, found_mean, found_n, missing_mean, missing_n).

    ``rows`` has (dataset, strategy, qtype, cluster, correct, recall). A verdict that is neither
    yes nor no counts as wrong; a null recall is neither found nor missing evidence.
    """
    own = _typed(rows.withColumn("value", F.coalesce("correct", F.lit(False)).cast("double")))
    by = ["dataset", "strategy", "qtype"]
    found, missing = F.when(F.col("recall") > 0, F.col("value")), F.when(F.col("recall") == 0, F.col("value"))
    sums = own.groupBy(*by).agg(F.count_if(F.col("correct").isNull()).alias("unparsed"), F.round(F.avg(found), 4).alias("found_mean"), F.count(found).alias("found_n"), F.round(F.avg(missing), 4).alias("missing_mean"), F.count(missing).alias("missing_n"))
    means = cluster_means(own, by)
    return means.join(sums, by).select(*by, "n", "unparsed", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "found_mean", "found_n", "missing_mean", "missing_n")


def best_config(rows: DataFrame) -> DataFrame:
    """(config, per_dataset, macro, best) from (config, dataset, recall): means rounded to 4 places.

    The best has the largest macro mean; ties go to the lowest config number.
    """
    per = rows.groupBy("config", "dataset").agg(F.round(F.avg("recall"), 4).alias("recall"))
    macro = per.groupBy("config").agg(F.round(F.avg("recall"), 4).alias("macro"))
    best = macro.agg(F.max_by("config", F.struct("macro", -F.col("config"))).alias("best"))
    return macro.crossJoin(F.broadcast(best)).select("config", "macro", (F.col("config") == F.col("best")).alias("best"))


def diagnostics(turns: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """One row for each data set: the size of its histories, and why its evidence is hard to find.

    Rates are of the questions that have what they are about: evidence that shares a word, a
    place, an answer with terms. Histories belong to the data set of their questions.
    """
    whose = questions.select("history_id", "dataset").distinct()
    sizes = turns.groupBy("history_id").agg(F.sum(count_tokens(F.col("text"))).alias("t"), F.count("*").alias("n")).join(whose, "history_id").groupBy("dataset")
    sizes = sizes.agg(F.count("*").alias("histories"), F.round(F.avg("t")).cast("bigint").alias("tokens_mean"), F.min("t").cast("bigint").alias("tokens_min"), F.max("t").cast("bigint").alias("tokens_max"), F.sum("n").alias("turns"))
    rate = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 4)
    named = questions.withColumn("w", query_window(F.col("question"), F.col("now"))).groupBy("dataset").agg(F.count("*").alias("questions"), rate(F.col("w").isNotNull()).alias("names_a_time"))
    of = questions.select("qid", "dataset")
    seen = evaluation.visibility(questions, gold, turns).groupBy("qid").agg(F.max("visible").alias("seen")).join(of, "qid").groupBy("dataset").agg(rate(~F.col("seen")).alias("no_visible_evidence"))
    place = evaluation.mean_positions(gold, turns).join(of, "qid").groupBy("dataset").agg(F.round(F.avg("mean_pos"), 4).alias("mean_position"), rate(F.col("mean_pos") >= 0.9).alias("in_newest_tenth"))
    where = evaluation.answer_location(questions, gold, turns).join(of, "qid").groupBy("dataset").agg(*[rate(F.col("location") == x).alias(x) for x in ("in_text", "needs_date", "elsewhere")])
    return named.join(sizes, "dataset").join(seen, "dataset", "left").join(place, "dataset", "left").join(where, "dataset", "left")
