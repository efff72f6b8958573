"""Scoring contexts by the gold evidence they hold, and why evidence is hard to find."""

from __future__ import annotations

import calendar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import terms
from recollect.plans.strategies import placed


def sampled_by_type(questions: DataFrame, each: int, seed: int = 0) -> DataFrame:
    """Up to ``each`` questions of every data set and type, by a hash of their ids that the seed fixes."""
    order = Window.partitionBy("dataset", "qtype").orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("qid"))), "qid")
    return questions.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= each).drop("_nth")


def gold(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(qid, turn_id, session_id, session_ts) for gold turns that exist; evidence has (qid, history_id, turn_id)."""
    known = turns.select("history_id", F.col("id").alias("turn_id"), "session_id", "session_ts")
    return evidence.join(known, ["history_id", "turn_id"])


def scores(contexts: DataFrame, questions: DataFrame, evidence: DataFrame, sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each question and context: recall of turns and sessions, and of the newest.

    ``contexts`` has (qid, strategy, budget, turn_id, session_id, cut), ``questions`` (qid,
    history_id, qtype), ``evidence`` (qid, history_id, turn_id), ``sessions`` (qid, session_id):
    gold sessions. Every question meets every (strategy, budget) of the contexts, so one that
    brought nothing scores zero. A metric is null where a question has no gold of its kind;
    ``measurable`` says whether it has any. newest and stale_only are for questions of updated
    knowledge whose latest gold session (ties by id) has gold turns.
    """
    grid = questions.select("qid", "history_id", "qtype").crossJoin(F.broadcast(contexts.select("strategy", "budget").distinct()))
    key = ["qid", "strategy", "budget"]
    held = contexts.select(*key, "turn_id", "cut")
    ev = gold(evidence, turns)
    when = turns.groupBy("history_id", "session_id").agg(F.min("session_ts").alias("session_ts"))
    gs = sessions.join(questions.select("qid", "history_id"), "qid").join(when, ["history_id", "session_id"], "left").select("qid", "session_id", "session_ts")
    latest = gs.groupBy("qid").agg(F.max_by("session_id", F.struct("session_ts", "session_id")).alias("latest"))
    per_turn = grid.select(*key).join(ev.join(latest, "qid", "left"), "qid").join(held, [*key, "turn_id"], "left")
    hit, new = F.col("cut").isNotNull(), F.col("session_id") == F.col("latest")
    by_turn = per_turn.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("hits"),
        F.count_if(hit & ~F.coalesce("cut", F.lit(False))).alias("whole"),
        F.count_if(F.coalesce(new, F.lit(False))).alias("n_new"),
        F.count_if(F.coalesce(new & hit, F.lit(False))).alias("hits_new"),
    )
    seen = contexts.select(*key, "session_id").distinct().withColumn("seen", F.lit(True))
    by_session = grid.select(*key).join(gs, "qid").join(seen, [*key, "session_id"], "left").groupBy(*key).agg(F.count("*").alias("m"), F.count_if(F.col("seen").isNotNull()).alias("found"))
    out = grid.join(by_turn, key, "left").join(by_session, key, "left")
    rate = lambda a, b: F.round(F.col(a) / F.col(b), 4)
    updated = (F.col("qtype") == "knowledge-update") & (F.col("m") > 0) & (F.col("n_new") > 0)
    return out.select(
        *key,
        "history_id",
        "qtype",
        (F.col("n").isNotNull() | F.col("m").isNotNull()).alias("measurable"),
        rate("hits", "n").alias("recall"),
        rate("whole", "n").alias("recall_strict"),
        (F.col("hits") == F.col("n")).alias("all"),
        rate("found", "m").alias("session_recall"),
        (F.col("found") == F.col("m")).alias("all_sessions"),
        F.when(updated, F.col("hits_new") > 0).alias("newest"),
        F.when(updated, (F.col("hits") > 0) & (F.col("hits_new") == 0)).alias("stale_only"),
    )


def reached(units: DataFrame, evidence: DataFrame, turns: DataFrame, reach: int, by: str = "config") -> DataFrame:
    """(qid, by, reach, recall): the share of a question's gold turns that units with neighbours hold.

    ``units`` has (qid, by, session_id, position) of each unit's hit. For every reach from 0 up to
    the given one: a gold turn is held if a hit of its session lies no further away, so no unit
    is written out with its neighbours.
    """
    at = placed(turns).select("history_id", F.col("id").alias("turn_id"), "session_id", F.col("position").alias("place"))
    own = evidence.join(at, ["history_id", "turn_id"]).select("qid", "turn_id", "session_id", "place")
    grid = own.select("qid", "turn_id").crossJoin(F.broadcast(units.select(by).distinct()))
    away = units.join(own, ["qid", "session_id"]).groupBy("qid", "turn_id", by).agg(F.min(F.abs(F.col("place") - F.col("position"))).alias("away"))
    wide = grid.join(away, ["qid", "turn_id", by], "left").select("qid", by, "away", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("reach"))
    hit = F.when(F.col("away") <= F.col("reach"), 1.0).otherwise(0.0)
    return wide.groupBy("qid", by, "reach").agg(F.round(F.avg(hit), 4).alias("recall"))


def positions(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(qid, turn_id, pos): where each gold turn stands in its history, 0 to 1."""
    at = placed(turns).withColumn("n", F.count("*").over(Window.partitionBy("history_id")))
    at = at.select("history_id", F.col("id").alias("turn_id"), F.round(F.col("position") / F.greatest(F.col("n") - 1, F.lit(1)), 4).alias("pos"))
    return evidence.join(at, ["history_id", "turn_id"]).select("qid", "turn_id", "pos")


def mean_positions(evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(qid, mean_pos) over the gold turns of histories of two turns or more."""
    at = placed(turns).withColumn("n", F.count("*").over(Window.partitionBy("history_id"))).where("n > 1")
    at = at.select("history_id", F.col("id").alias("turn_id"), (F.col("position") / (F.col("n") - 1)).alias("pos"))
    return evidence.join(at, ["history_id", "turn_id"]).groupBy("qid").agg(F.avg("pos").alias("mean_pos"))


def visibility(questions: DataFrame, evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(qid, turn_id, visible): whether a gold turn shares a term with the question.

    Terms of the names of the history's speakers do not count.
    """
    names = turns.select("history_id", F.explode(terms(F.col("speaker"))).alias("w")).distinct().groupBy("history_id").agg(F.collect_set("w").alias("names"))
    q = questions.join(names, "history_id", "left").select("qid", F.array_except(terms(F.col("question")), F.coalesce("names", F.array().cast("array<string>"))).alias("q"))
    found = gold(evidence, turns.withColumn("t", terms(F.col("text")))).join(turns.select("history_id", F.col("id").alias("turn_id"), terms(F.col("text")).alias("t")), ["history_id", "turn_id"])
    return found.join(q, "qid").select("qid", "turn_id", F.arrays_overlap("q", "t").alias("visible"))


#: Words that speak of dates beside the names of months and days (fixed values).
DATE_WORDS = "week weekend month year day ago last next before after early late mid around beginning end morning evening night"


def _is_date(word: Column) -> Column:
    names = " ".join([*calendar.month_name[1:], *calendar.month_abbr[1:], *calendar.day_name]) + " " + DATE_WORDS
    known = terms(F.lit(names))
    return word.rlike("^[0-9]+$") | F.array_contains(known, word) | F.rtrim(word, F.lit("thsndr")).rlike("^[0-9]+$")


def answer_location(questions: DataFrame, evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(qid, location): whether the answer's terms stand in the gold turns (in_text), lack only
    dates (needs_date), or something else (elsewhere). Questions without gold turns or without
    terms in the answer have no row; ``questions`` has (qid, answer)."""
    said = gold(evidence, turns).join(turns.select("history_id", F.col("id").alias("turn_id"), terms(F.col("text")).alias("t")), ["history_id", "turn_id"])
    said = said.groupBy("qid").agg(F.flatten(F.collect_list("t")).alias("t"))
    rows = questions.select("qid", F.array_distinct(terms(F.col("answer"))).alias("a")).where(F.size("a") > 0).join(said, "qid")
    rows = rows.withColumn("missing", F.array_except("a", "t"))
    datelike = F.exists("missing", lambda w: ~w.rlike("^[0-9]+$") | (F.length(w) == 4))
    return rows.select("qid", F.when(F.size("missing") == 0, "in_text").when(datelike & F.forall("missing", _is_date), "needs_date").otherwise("elsewhere").alias("location"))


def answer_present(questions: DataFrame, evidence: DataFrame, turns: DataFrame) -> DataFrame:
    """(qid, present): whether the answer stands, in any case, in the gold turns' texts put together."""
    texts = gold(evidence, turns).join(turns.select("history_id", F.col("id").alias("turn_id"), "text", "seq"), ["history_id", "turn_id"])
    said = texts.groupBy("qid").agg(F.array_join(F.sort_array(F.collect_list(F.struct("session_ts", "session_id", "seq", "text"))).getField("text"), " ").alias("said"))
    return questions.select("qid", "answer").join(said, "qid").select("qid", F.contains(F.lower("said"), F.lower("answer")).alias("present"))
