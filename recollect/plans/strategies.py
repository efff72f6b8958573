"""Retrieval strategies: each turns questions into ranked units of turns.

Turns have (history_id, id, session_id, session_ts, speaker, text, ts, seq); questions have (qid,
history_id, question, now). A plan has a row for each turn wanted: (qid, history_id, strategy,
unit_ord, turn_ord, turn_id). The plans of full_head and sliding_window name every turn of a
history; ``packing.packed_prefix`` packs them without a row for each.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.parsing import dot, unit_vector
from recollect.functions.temporal import query_window
from recollect.functions.text import terms
from recollect.operators import bm25, timed
from recollect.sources.kept import kept

RRF_K = 60


@dataclass(frozen=True)
class Config:
    """Weights of the store's score; zero switches a part off."""

    session_weight: float = 0.3
    half_life_days: float = 365.0
    recency_floor: float = 0.5
    window_boost: float = 1.0
    neighbours: int = 0

    @staticmethod
    def grid(**values: tuple) -> list[Config]:
        """Every combination of the given values; the last name varies fastest."""
        return [Config(**dict(zip(values, x, strict=True))) for x in itertools.product(*values.values())]

    def without(self, component: str) -> Config:
        off = {"session": "session_weight", "recency": "half_life_days", "window": "window_boost", "neighbours": "neighbours"}
        if component not in off:
            raise ValueError(f"unknown component {component!r}; choose from {sorted(off)}")
        return replace(self, **{off[component]: 0})


def placed(turns: DataFrame) -> DataFrame:
    """The turns with ``position``, from 0 in order of session start, session and seq."""
    order = Window.partitionBy("history_id").orderBy("session_ts", "session_id", "seq")
    return turns.withColumn("position", F.row_number().over(order) - 1)


def said(speaker: str = "speaker", text: str = "text") -> Column:
    return F.concat(speaker, F.lit(" "), text)


def turn_terms(turns: DataFrame) -> DataFrame:
    """(history_id, id, session_id, ts, terms), kept: cutting and stemming is most of the work and most of a
    plan, and postings, lengths and both indexes read it. ``Said`` keeps it for several searches."""
    return kept(turns.select("history_id", "id", "session_id", "ts", terms(said()).alias("terms")), "terms")


def asked(questions: DataFrame) -> DataFrame:
    """(qid, history_id, now, terms) of questions, kept."""
    return kept(questions.select("qid", "history_id", "now", terms(F.col("question")).alias("terms")), "asked")


@dataclass(frozen=True)
class Said:
    """The terms of turns and questions, cut once for all searches over them."""

    turns: DataFrame
    questions: DataFrame
    visible: bool = False  # each question sees the turns said at or before its now, as if there were no others

    @staticmethod
    def of(turns: DataFrame, questions: DataFrame, visible: bool = False) -> Said:
        return Said(turn_terms(turns), asked(questions), visible)

    def found(self, doc: str) -> DataFrame:
        """BM25 scores of turns (``id``) or sessions (``session_id``)."""
        own = self.turns.select("history_id", F.col(doc).alias("doc_id"), "ts", "terms")
        if self.visible:
            return timed.scores(timed.build(own), self.questions)
        return bm25.scores(bm25.build(own) if doc == "id" else _sessions(own), self.questions)


def _sessions(own: DataFrame) -> bm25.Index:
    """Terms of a session are those of its turns, joined by spaces, so each turn is cut alone."""
    return bm25.build(own.groupBy("history_id", "doc_id").agg(F.flatten(F.collect_list("terms")).alias("terms")))


def turn_index(turns: DataFrame) -> bm25.Index:
    return bm25.build(turn_terms(turns).select("history_id", F.col("id").alias("doc_id"), "terms"))


def session_index(turns: DataFrame) -> bm25.Index:
    return _sessions(turn_terms(turns).select("history_id", F.col("session_id").alias("doc_id"), "terms"))


def age_days(now: Column, ts: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000


def decay(age: Column, half_life: float, floor: float) -> Column:
    return floor + (1 - floor) * F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / half_life)


def _normal(scores: DataFrame) -> DataFrame:
    top = F.max("score").over(Window.partitionBy("qid"))
    return scores.withColumn("score", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")))


def turn_scores(turns: DataFrame, questions: DataFrame, visible: bool = False, of: Said | None = None) -> DataFrame:
    """(qid, history_id, id, score, position, session_id, ts, now, question) of turns sharing a term."""
    found = (of or Said.of(turns, questions, visible)).found("id").withColumnRenamed("doc_id", "id")
    of_turn = placed(turns).select("history_id", "id", "position", "session_id", "ts")
    return found.join(of_turn, ["history_id", "id"]).join(questions.select("qid", "now", "question"), "qid")


def score_parts(turns: DataFrame, questions: DataFrame, sessions: bool = True, windows: bool = True, visible: bool = False) -> DataFrame:
    """The turns that share a term with a question, with what the store's score is made of.

    ``raw`` is the turn's score, ``base`` the same and ``session`` that of its session (each divided
    by the question's best), ``age`` its days before now, ``inside`` whether it falls in the window the question names.
    """
    of = Said.of(turns, questions, visible)
    found = _normal(turn_scores(turns, questions, of=of).withColumn("raw", F.col("score"))).withColumn("age", age_days(F.col("now"), F.col("ts"))).withColumnRenamed("score", "base")
    if sessions:
        own = _normal(of.found("session_id")).select("qid", F.col("doc_id").alias("session_id"), F.col("score").alias("session"))
        found = found.join(own, ["qid", "session_id"], "left").withColumn("session", F.coalesce("session", F.lit(0.0)))
    if windows:
        named = kept(questions.select("qid", query_window(F.col("question"), F.col("now")).alias("w")), "windows")
        inside = F.coalesce((F.col("w.lo") <= F.col("ts")) & (F.col("ts") < F.col("w.hi")), F.lit(False))
        found = found.join(named, "qid").withColumn("inside", inside).drop("w")
    return found


def store_scores(turns: DataFrame, questions: DataFrame, config: Config = Config(), visible: bool = False) -> DataFrame:
    """The turns' scores fused with their sessions', decayed by age and raised inside the window.

    ``visible``: each question sees the turns said at or before its own now, and no statistic of later ones.
    """
    parts = score_parts(turns, questions, bool(config.session_weight), bool(config.window_boost), visible)
    score = F.col("base") + config.session_weight * F.col("session") if config.session_weight else F.col("base")
    if config.half_life_days:
        score = score * decay(F.col("age"), config.half_life_days, config.recency_floor)
    if config.window_boost:
        score = score * F.when(F.col("inside"), 1 + config.window_boost).otherwise(1.0)
    return parts.withColumn("score", score).drop("raw", "base", "session", "age", "inside")


def grid_scores(parts: DataFrame, configs: list[Config]) -> DataFrame:
    """``score_parts`` with the score under each configuration, by its number in the list.

    The parts are made once for all of them; configurations are a parameter of the call.
    """
    rows = [F.struct(F.lit(k).alias("config"), F.lit(float(c.session_weight)).alias("w"), F.lit(float(c.half_life_days)).alias("h"), F.lit(c.recency_floor).alias("f"), F.lit(float(c.window_boost)).alias("b")) for k, c in enumerate(configs)]
    wide = parts.select("*", F.inline(F.array(*rows)))
    half = F.when(F.col("h") > 0, F.pow(F.lit(0.5), F.greatest("age", F.lit(0.0)) / F.col("h"))).otherwise(1.0)
    kept = F.when(F.col("h") > 0, F.col("f") + (1 - F.col("f")) * half).otherwise(1.0)
    raised = F.when(F.col("inside"), 1 + F.col("b")).otherwise(1.0)
    return wide.withColumn("score", (F.col("base") + F.col("w") * F.col("session")) * kept * raised).drop("w", "h", "f", "b")


def _units(ranked: DataFrame, strategy: str) -> DataFrame:
    return ranked.select("qid", "history_id", F.lit(strategy).alias("strategy"), F.col("rank").alias("unit_ord"), F.lit(0).alias("turn_ord"), F.col("id").alias("turn_id"))


def with_neighbours(units: DataFrame, turns: DataFrame, reach: int) -> DataFrame:
    """Each unit's hit followed by its neighbours of the same session, nearest and left first."""
    if not reach:
        return units
    offsets = [0] + [d for k in range(1, reach + 1) for d in (-k, k)]
    where = placed(turns).select("history_id", "position", "session_id", "id")
    hit = units.join(where.withColumnRenamed("id", "turn_id"), ["history_id", "turn_id"])
    wide = hit.select(*[c for c in hit.columns if c not in ("turn_ord", "turn_id", "position")], F.posexplode(F.array(*[F.col("position") + d for d in offsets])).alias("turn_ord", "position"))
    return wide.join(where, ["history_id", "session_id", "position"]).withColumnRenamed("id", "turn_id").select(*units.columns)


def _everything(turns: DataFrame, questions: DataFrame, order: Column) -> DataFrame:
    every = questions.select("qid", "history_id").join(placed(turns).select("history_id", "id", "position"), "history_id")
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order, "position")))


def full_head(turns: DataFrame, questions: DataFrame) -> DataFrame:
    return _units(_everything(turns, questions, F.col("position").asc()), "full_head")


def sliding_window(turns: DataFrame, questions: DataFrame) -> DataFrame:
    return _units(_everything(turns, questions, F.col("position").desc()), "sliding_window")


def random_turns(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Every turn in an order that a hash of question and turn fixes."""
    return _units(_everything(turns, questions, F.sha2(F.concat(F.col("qid"), F.lit("|"), F.col("id")), 256).asc()), "random")


def bm25_turns(turns: DataFrame, questions: DataFrame) -> DataFrame:
    return _units(bm25.ranked(turn_scores(turns, questions), "position"), "bm25_turns")


def bm25_sessions(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """Whole sessions by their scores, turns in order of seq."""
    starts = turns.groupBy("history_id", "session_id").agg(F.min("session_ts").alias("session_ts"))
    found = Said.of(turns, questions).found("session_id").withColumnRenamed("doc_id", "session_id").join(starts, ["history_id", "session_id"])
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), "session_ts", "session_id")
    ranked = found.withColumn("unit_ord", F.row_number().over(order)).join(turns.select("history_id", "session_id", "id", "seq"), ["history_id", "session_id"])
    return ranked.select("qid", "history_id", F.lit("bm25_sessions").alias("strategy"), "unit_ord", F.col("seq").cast("int").alias("turn_ord"), F.col("id").alias("turn_id"))


def recency_bm25(turns: DataFrame, questions: DataFrame, half_life_days: float = 30.0, floor: float = 0.0) -> DataFrame:
    aged = turn_scores(turns, questions).withColumn("score", F.col("score") * decay(age_days(F.col("now"), F.col("ts")), half_life_days, floor)).where("score > 0")
    return _units(bm25.ranked(aged, "position"), "recency_bm25")


def window_bm25(turns: DataFrame, questions: DataFrame) -> DataFrame:
    """BM25 hits for what ``packing.packed_split`` leaves beside the newest turns."""
    return _units(bm25.ranked(turn_scores(turns, questions), "position"), "window_bm25")


def with_visible_neighbours(units: DataFrame, turns: DataFrame, questions: DataFrame, reach: int) -> DataFrame:
    """``with_neighbours`` among the turns that each question could see: later ones leave no gap between others."""
    if not reach:
        return units
    where = placed(turns).select("history_id", "position", "session_id", "id", "ts")
    hit = units.join(where.select("history_id", F.col("id").alias("turn_id"), "session_id"), ["history_id", "turn_id"])
    seen = hit.select("qid", "history_id", "session_id").distinct().join(where, ["history_id", "session_id"]).join(questions.select("qid", "now"), "qid").where(F.col("ts") <= F.col("now"))
    seen = seen.select("qid", "session_id", "id", F.row_number().over(Window.partitionBy("qid", "session_id").orderBy("position")).alias("nth"))
    offsets = [0] + [d for k in range(1, reach + 1) for d in (-k, k)]
    own = hit.join(seen.withColumnRenamed("id", "turn_id"), ["qid", "session_id", "turn_id"])
    wide = own.select("qid", "history_id", "strategy", "unit_ord", "session_id", F.posexplode(F.array(*[F.col("nth") + d for d in offsets])).alias("turn_ord", "nth"))
    return wide.join(seen, ["qid", "session_id", "nth"]).withColumnRenamed("id", "turn_id").select(*units.columns)


def store(turns: DataFrame, questions: DataFrame, config: Config = Config(), name: str = "store", visible: bool = False) -> DataFrame:
    """The store's search. ``visible``: every question as of its own now, over one index."""
    units = _units(bm25.ranked(store_scores(turns, questions, config, visible).where("score > 0"), "position"), name)
    return with_visible_neighbours(units, turns, questions, config.neighbours) if visible else with_neighbours(units, turns, config.neighbours)


def dense_scores(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, history_id, id, position, score): cosines of (history_id, id, position, v) and (qid, history_id, v)."""
    docs = vectors.select("history_id", "id", "position", unit_vector(F.col("v")).alias("d"))
    return queries.select("qid", "history_id", unit_vector(F.col("v")).alias("q")).join(docs, "history_id").select("qid", "history_id", "id", "position", dot(F.col("q"), F.col("d")).alias("score"))


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Every turn by its cosine with the question."""
    return _units(bm25.ranked(dense_scores(vectors, queries), "position"), "dense")


def fused(sparse: DataFrame, dense_: DataFrame, k: int = RRF_K) -> DataFrame:
    """(qid, history_id, id, rrf, rank): reciprocal ranks of two scorings, summed; scores over 0 count.

    Ties go to what the first scoring ranks first, then to the second's rank.
    """
    a = bm25.ranked(sparse.where("score > 0"), "position").select("qid", "history_id", "id", F.col("rank").alias("a"))
    b = bm25.ranked(dense_.where("score > 0"), "position").select("qid", "history_id", "id", F.col("rank").alias("b"))
    both = a.join(b, ["qid", "history_id", "id"], "full_outer")
    part = lambda r: F.coalesce(1 / (k + F.col(r)), F.lit(0.0))
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), F.col("a").asc_nulls_last(), F.col("b").asc_nulls_last())
    return both.withColumn("rrf", part("a") + part("b")).withColumn("rank", F.row_number().over(order)).drop("a", "b")


def hybrid(turns: DataFrame, questions: DataFrame, vectors: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    units = _units(fused(store_scores(turns, questions, config), dense_scores(vectors, queries)), "hybrid")
    return with_neighbours(units, turns, config.neighbours)


#: What a plan has for each turn wanted.
PLAN = ("qid", "history_id", "strategy", "unit_ord", "turn_ord", "turn_id")
#: Strategies by name: functions of turns and questions.
_NAMED: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    f.__name__: f for f in (full_head, sliding_window, bm25_turns, bm25_sessions, recency_bm25, store)
} | {"random": random_turns}


def name_strategy(name: str, plan: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """Lets ``planned`` know a strategy of one's own, which returns (qid, unit_ord, turn_ord, turn_id)."""
    _NAMED[name] = plan


def planned(names: list[str], turns: DataFrame, questions: DataFrame) -> DataFrame:
    """The plans of the named strategies, one below the other, for packing and evaluation."""
    unknown = [n for n in names if n not in _NAMED]
    if unknown or not names:
        raise ValueError(f"unknown strategies {unknown}; known are {sorted(_NAMED)}")
    out = None
    for name in names:
        plan = _NAMED[name](turns, questions)
        missing = {"qid", "unit_ord", "turn_ord", "turn_id"} - set(plan.columns)
        if missing:
            raise ValueError(f"the plan of {name!r} has no {sorted(missing)}")
        own = plan.select("qid", F.col("unit_ord").cast("int").alias("unit_ord"), F.col("turn_ord").cast("int").alias("turn_ord"), "turn_id")
        own = own.join(questions.select("qid", "history_id"), "qid").withColumn("strategy", F.lit(name)).select(*PLAN)
        out = own if out is None else out.unionByName(own)
    return out
