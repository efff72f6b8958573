"""Registered queries over the driver's tables, with the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect import oracle as o
from recollect.functions import parsing, temporal, text
from recollect.operators import bm25, dense, evaluation, facts, products, reports, stats, store
from recollect.plans import memory, packing, strategies
from recollect.sources import files, tables
from recollect.sources.kept import folder as kept_folder
from recollect.sources.kept import kept

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
K = 10
BUDGETS = (256, 1024)


def queries() -> dict[str, Query]:
    return _QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_turns_topk(spark, sf_dir)


def registered(sql: str | None = None, **extra: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = o.assemble(sql, **extra)
        return f

    return add


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.turns(spark, sf_dir), tables.questions(spark, sf_dir)


def r6(x: str | Column) -> Column:
    return F.round(x, 6)


# Scalar functions


@registered(f"SELECT doc_id, array_to_string({o.terms('text')}, ' ') AS terms, len({o.terms('text')})::BIGINT AS n FROM documents")
def text_terms(spark, sf_dir):
    t = text.terms(F.col("text"))
    return tables.table(spark, sf_dir, "documents").select("doc_id", F.array_join(t, " ").alias("terms"), F.size(t).cast("bigint").alias("n"))


@registered(f"SELECT doc_id, {o.tokens('text')} AS tokens FROM documents")
def text_token_count(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", text.count_tokens(F.col("text")).cast("bigint").alias("tokens"))


@registered(f"SELECT id, {o.truncated('text', 32)} AS text FROM turns")
def text_truncate(spark, sf_dir):
    return tables.turns(spark, sf_dir).select("id", text.truncated(F.col("text"), 32).alias("text"))


@registered("SELECT qid, w.lo AS lo, w.hi AS hi FROM windows")
def query_window(spark, sf_dir):
    q = tables.questions(spark, sf_dir)
    return q.select("qid", temporal.query_window(F.col("question"), F.col("now")).alias("w")).select("qid", "w.lo", "w.hi")


@registered("SELECT event_id, date_trunc('minute', ts) AS clock, date_trunc('minute', ts) AS slashed, date_trunc('second', ts) AS iso, date_trunc('minute', ts) - INTERVAL 5 HOUR AS moved FROM events")
def parse_timestamp(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    read = lambda pattern, tail="": temporal.parse_timestamp(F.concat(F.date_format("ts", pattern), F.lit(tail)))
    return e.select("event_id", read("h:mm a 'on' d MMMM, yyyy").alias("clock"), read("yyyy/MM/dd (EEE) HH:mm").alias("slashed"), read("yyyy-MM-dd'T'HH:mm:ss").alias("iso"), read("yyyy-MM-dd'T'HH:mm", "+05:00").alias("moved"))


@registered(f"SELECT DISTINCT source AS cluster, {o.split_of('source')} AS split FROM documents WHERE source IS NOT NULL")
def split_cluster(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").where("source is not null").select("source").distinct()
    return d.select(F.col("source").alias("cluster"), parsing.split_of(F.col("source")).alias("split"))


@registered("SELECT event_id, ['D' || (event_id % 40) || ':' || (user_id % 30), 'D' || (event_id % 7) || ':' || (event_id % 11)] AS ids FROM events".replace("SELECT event_id, [", "SELECT event_id, array_to_string([").replace("] AS ids", "], ';') AS ids"))
def evidence_repair(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    raw = F.concat(F.lit("D:"), (F.col("event_id") % 40).cast("string"), F.lit(":0"), (F.col("user_id") % 30).cast("string"), F.lit("; D0"), (F.col("event_id") % 7).cast("string"), F.lit(":"), (F.col("event_id") % 11).cast("string"), F.lit(" D"))
    return e.select("event_id", F.array_join(parsing.evidence_ids(raw), ";").alias("ids"))


@registered(r"SELECT doc_id, CASE regexp_extract(lower(text), '\b(yes|no)\b', 1) WHEN 'yes' THEN true WHEN 'no' THEN false END AS verdict FROM documents")
def parse_verdict(spark, sf_dir):
    return tables.table(spark, sf_dir, "documents").select("doc_id", parsing.verdict(F.col("text")).alias("verdict"))


@registered("SELECT event_id, 'user_' || user_id AS subject, event_type AS attribute, value::DECIMAL(18, 2)::VARCHAR AS value, (event_id % 4)::INT AS turn FROM events WHERE event_id % 4 < 3")
def extract_parse(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    item = F.to_json(F.struct(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("attribute"), F.col("value").cast("decimal(18,2)").cast("string").alias("value"), F.pmod("event_id", F.lit(4)).alias("turn")))
    reply = F.concat(F.lit("Here is what I found:\n```json\n["), item, F.lit(', {"subject": " ", "attribute": "x", "value": "y", "turn": 0}, {"subject": "a", "attribute": "b", "value": "c", "turn": true}]\n```'))
    return e.select("event_id", F.explode(parsing.extracted_facts(reply, F.lit(3))).alias("f")).select("event_id", "f.*")


@registered(
    "SELECT vec_id, round(list_dot_product(e, e0) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(e0, e0)), 6) AS cosine FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), (SELECT embedding::DOUBLE[] AS e0 FROM embeddings ORDER BY vec_id LIMIT 1)"
)
def cosine(spark, sf_dir):
    e = tables.table(spark, sf_dir, "embeddings").select("vec_id", parsing.unit_vector(F.col("embedding")).alias("v"))
    first = e.orderBy("vec_id").limit(1).select(F.col("v").alias("v0"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", r6(parsing.dot(F.col("v"), F.col("v0"))).alias("cosine"))


# BM25 and retrieval


@registered(f"SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM rank_turns WHERE rank <= {K}")
def bm25_turns_topk(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return bm25.ranked(strategies.turn_scores(turns, questions), "position", K).select("qid", "id", "rank", r6("score").alias("score"))


@registered(
    f"SELECT qid, doc_id AS id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS rank FROM wscore) WHERE rank <= {K}",
    qterms=f"SELECT DISTINCT qid, 0::BIGINT AS history_id, unnest({o.terms('question')}) AS term FROM questions",
    wdocs="SELECT 0::BIGINT AS history_id, doc_id, ts_ FROM tdocs",
    wscore=o._bm25("wdocs"),
)
def bm25_store_topk(spark, sf_dir):
    """The first hits of every question among the turns of all histories, found by products of blocks."""
    turns, questions = both(spark, sf_dir)
    one = F.lit(0).cast("bigint")
    of = strategies.Said.of(turns.withColumn("history_id", one), questions.withColumn("history_id", one))
    docs = of.turns.select("history_id", F.col("id").alias("doc_id"), "terms")
    return bm25.ranked(products.best(docs, of.questions, K), k=K).select("qid", F.col("doc_id").alias("id"), "rank", r6("score").alias("score"))


@registered(f"SELECT qid, doc_id AS session_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id::INT) AS rank FROM sscore) WHERE rank <= {K}")
def bm25_sessions_topk(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    found = strategies.Said.of(turns, questions).found("session_id").withColumn("n", F.col("doc_id").cast("int"))
    return bm25.ranked(found, "n", K).select("qid", F.col("doc_id").alias("session_id"), r6("score").alias("score"))


@registered(
    f"SELECT history_id, term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf, round(any_value(ln(1 + (n - df_ + 0.5) / (df_ + 0.5))), 6) AS idf FROM (SELECT *, count(*) OVER (PARTITION BY history_id, term) AS df_ FROM (SELECT history_id, doc_id, term, count(*) AS tf FROM (SELECT history_id, doc_id, unnest(ts_) AS term FROM tdocs) GROUP BY ALL)) JOIN (SELECT history_id, count(*) AS n FROM tdocs GROUP BY 1) USING (history_id) GROUP BY ALL"
)
def bm25_index(spark, sf_dir):
    index = strategies.turn_index(tables.turns(spark, sf_dir))
    stats_ = index.postings.groupBy("history_id", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf")).join(index.corpus, "history_id")
    return stats_.select("history_id", "term", "df", "tf", r6(bm25.idf(F.col("n"), F.col("df"))).alias("idf"))


@registered(f"SELECT qid, id, round(score, 6) AS score FROM (SELECT *, doc_id AS id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, position) AS rank FROM (SELECT * REPLACE (score * pow(0.5, greatest(epoch_us(now) - epoch_us(ts), 0) / 86400000000.0 / 30) AS score) FROM tfull)) WHERE rank <= {K}")
def recency_bm25(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    found = strategies.turn_scores(turns, questions)
    aged = found.withColumn("score", F.col("score") * strategies.decay(strategies.age_days(F.col("now"), F.col("ts")), 30.0, 0.0))
    return bm25.ranked(aged, "position", K).select("qid", "id", r6("score").alias("score"))


@registered("SELECT qid, id, round(score, 6) AS score FROM store")
def store_score(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return strategies.store_scores(turns, questions).select("qid", "id", r6("score").alias("score"))


#: Each question asked at a time of its own, while its history goes on; turns are an hour apart.
_VISIBLE = {
    "vq": f"SELECT * REPLACE ({o.EPOCH} + to_days((substr(qid, 2)::INT + substr(qid, 2)::INT % 7)::INT) + INTERVAL 3 HOUR AS now) FROM questions",
    "vt": "SELECT * REPLACE (ts + to_hours(seq::INT) AS ts) FROM pos",
    "vturns": "SELECT q.qid, t.history_id, t.id AS doc_id, t.session_id, d.ts_ FROM vq q JOIN vt t ON t.history_id = q.history_id AND t.ts <= q.now JOIN tdocs d ON d.doc_id = t.id AND d.history_id = t.history_id",
    "vsessions": "SELECT qid, history_id, session_id AS doc_id, flatten(list(ts_)) AS ts_ FROM vturns GROUP BY ALL",
    "vtscore": o.bm25_by_question("vturns"),
    "vsscore": o.bm25_by_question("vsessions"),
    "vfull": "SELECT s.*, s.doc_id AS id, t.position, t.session_id, t.ts, q.now FROM vtscore s JOIN vt t ON t.history_id = s.history_id AND t.id = s.doc_id JOIN vq q USING (qid)",
    "vwindows": f"SELECT qid, {o.window('question', 'now')} AS w FROM vq",
}


def _asked_meanwhile(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    turns, questions = both(spark, sf_dir)
    conv = F.substr("qid", F.lit(2)).cast("int")
    now = F.lit(tables.EPOCH).cast("timestamp_ntz") + F.make_dt_interval(conv + conv % 7, F.lit(3))
    return turns.withColumn("ts", F.col("ts") + F.make_dt_interval(F.lit(0), F.col("seq").cast("int"))), questions.withColumn("now", now)


@registered(f"SELECT qid, id, rank::INT AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, position) AS rank FROM vfull) WHERE rank <= {K}", **_VISIBLE)
def visible_topk(spark, sf_dir):
    turns, questions = _asked_meanwhile(spark, sf_dir)
    return bm25.ranked(strategies.turn_scores(turns, questions, visible=True), "position", K).select("qid", "id", "rank", r6("score").alias("score"))


@registered(
    """SELECT qid, id, round((score / top + 0.3 * coalesce(s, 0)) * (0.5 + 0.5 * pow(0.5, greatest(epoch_us(now) - epoch_us(ts), 0) / 86400000000.0 / 365.0)) * CASE WHEN coalesce(w.lo <= ts AND ts < w.hi, false) THEN 2 ELSE 1 END, 6) AS score
  FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM vfull) t JOIN vwindows USING (qid)
  LEFT JOIN (SELECT qid AS q2, doc_id AS s2, score / max(score) OVER (PARTITION BY qid) AS s FROM vsscore) ON q2 = qid AND s2 = session_id""",
    **_VISIBLE,
)
def visible_store(spark, sf_dir):
    turns, questions = _asked_meanwhile(spark, sf_dir)
    return strategies.store_scores(turns, questions, visible=True).select("qid", "id", r6("score").alias("score"))


_PARTS = "SELECT t.*, doc_id AS id, score / top AS b, coalesce(s, 0) AS s, greatest(epoch_us(now) - epoch_us(ts), 0) / 86400000000.0 AS age, coalesce(w.lo <= ts AND ts < w.hi, false) AS inside FROM (SELECT *, max(score) OVER (PARTITION BY qid) AS top FROM tfull) t JOIN windows USING (qid) LEFT JOIN (SELECT qid AS q2, doc_id AS s2, score / max(score) OVER (PARTITION BY qid) AS s FROM sscore) ON q2 = qid AND s2 = session_id"


@registered(
    f"SELECT a.qid, component, rank::INT AS unit_ord, o.k::INT AS turn_ord, p.id AS turn_id FROM ablated a, (VALUES (0, 0), (1, -1), (2, 1)) AS o(k, d) JOIN pos p ON p.history_id = a.history_id AND p.session_id = a.session_id AND p.position = a.position + o.d WHERE rank <= {K} AND (k = 0 OR component <> 'neighbours')",
    parts=_PARTS,
    ablated="""SELECT *, row_number() OVER (PARTITION BY qid, component ORDER BY round(value, 12) DESC, position) AS rank FROM (
  SELECT qid, history_id, session_id, position, component, (b + CASE component WHEN 'session' THEN 0 ELSE 0.3 * s END) * CASE component WHEN 'recency' THEN 1 ELSE 0.5 + 0.5 * pow(0.5, age / 365.0) END * CASE WHEN inside AND component <> 'window' THEN 2 ELSE 1 END AS value
  FROM parts, (VALUES ('session'), ('recency'), ('window'), ('neighbours')) AS c(component))""",
)
def store_ablations(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    names, whole = ("session", "recency", "window", "neighbours"), strategies.Config(neighbours=1)
    found = strategies.grid_scores(strategies.score_parts(turns, questions), [whole.without(c) for c in names])
    order = Window.partitionBy("qid", "config").orderBy(F.round("score", 12).desc(), "position")
    hits = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= K)
    named = hits.withColumn("component", F.get(F.array(*map(F.lit, names)), F.col("config")))
    units = named.select("qid", "history_id", "component", F.col("rank").alias("unit_ord"), F.lit(0).alias("turn_ord"), F.col("id").alias("turn_id"))
    wide = strategies.with_neighbours(units.where("component <> 'neighbours'"), turns, 1)
    return wide.unionByName(units.where("component = 'neighbours'")).select("qid", "component", "unit_ord", "turn_ord", "turn_id")


#: Values that the sweep crosses (fixed values); neighbours are counted by reach.
GRID = {"session_weight": (0.0, 0.15, 0.3, 0.6), "half_life_days": (0.0, 90.0, 365.0), "window_boost": (0.0, 1.0)}
REACH = 2


@registered(
    "SELECT config, round(macro, 4) AS macro, config = (SELECT config FROM swept ORDER BY round(macro, 4) DESC, config LIMIT 1) AS best FROM swept",
    parts=_PARTS,
    devq="SELECT qid, dataset, turn_id FROM questions WHERE split = 'dev'",
    valued="""SELECT parts.*, ((i * 3 + j) * 2 + k) AS cell, (b + [0.0, 0.15, 0.3, 0.6][i + 1]::DOUBLE * s) * CASE j WHEN 0 THEN 1 ELSE 0.5 + 0.5 * pow(0.5, age / [0.0, 90.0, 365.0][j + 1]::DOUBLE) END * CASE WHEN inside AND k = 1 THEN 2 ELSE 1 END AS value
  FROM parts JOIN devq USING (qid), range(4) a(i), range(3) b(j), range(2) c(k)""",
    units="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, cell ORDER BY round(value, 12) DESC, position) AS rank FROM valued WHERE value > 0) WHERE rank <= 3",
    away="SELECT u.qid, u.cell, min(abs(p.position - u.position)) AS d FROM units u JOIN devq g ON g.qid = u.qid JOIN pos p ON p.id = g.turn_id AND p.session_id = u.session_id GROUP BY 1, 2",
    held="SELECT c.cell * 3 + n AS config, g.dataset, CASE WHEN d <= n THEN 1.0 ELSE 0.0 END AS recall FROM devq g, (SELECT DISTINCT cell FROM units) c, range(3) r(n) LEFT JOIN away a ON a.qid = g.qid AND a.cell = c.cell",
    swept="SELECT config, avg(recall) AS macro FROM (SELECT config, dataset, round(avg(recall), 4) AS recall FROM held GROUP BY ALL) GROUP BY 1",
)
def sweep_grid(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    dev = questions.where("split = 'dev'")
    found = strategies.grid_scores(strategies.score_parts(turns, dev), strategies.Config.grid(**GRID))
    order = Window.partitionBy("qid", "config").orderBy(F.round("score", 12).desc(), "position")
    units = found.where("score > 0").withColumn("rank", F.row_number().over(order)).where("rank <= 3").select("qid", "config", "session_id", "position")
    held = evaluation.reached(units, dev.select("qid", "history_id", "turn_id"), turns, REACH).join(dev.select("qid", "dataset"), "qid")
    return reports.best_config(held.select((F.col("config") * (REACH + 1) + F.col("reach")).cast("bigint").alias("config"), "dataset", "recall"))


@registered(
    f"SELECT r.qid, r.rank::INT AS unit_ord, o.k::INT AS turn_ord, p.id AS turn_id FROM rank_turns r, (VALUES (0, 0), (1, -1), (2, 1), (3, -2), (4, 2)) AS o(k, d) JOIN pos p ON p.history_id = r.history_id AND p.session_id = r.session_id AND p.position = r.position + o.d WHERE r.rank <= {K}"
)
def neighbours(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    units = strategies._units(bm25.ranked(strategies.turn_scores(turns, questions), "position", K), "bm25")
    return strategies.with_neighbours(units, turns, 2).select("qid", "unit_ord", "turn_ord", "turn_id")


def _vectors(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Embeddings by label as histories; the vectors whose ids are divisible by 20 are the questions."""
    e = tables.table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("label").alias("history_id"), F.col("vec_id").alias("id"), F.col("vec_id").alias("position"), F.col("embedding").alias("v"))
    return e, e.where("id % 20 = 0").select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("qid"), "history_id", "v")


_UNIT = "SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x::DOUBLE) AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings WHERE label IS NOT NULL"
_DENSE = "SELECT 'v' || q.vec_id AS qid, d.vec_id AS id, list_dot_product(q.e, d.e) / q.norm / d.norm AS score FROM unit q JOIN unit d USING (label) WHERE q.vec_id % 20 = 0"


@registered(f"SELECT qid, id, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS rank FROM dense) WHERE rank <= {K}", unit=_UNIT, dense=_DENSE)
def dense_topk(spark, sf_dir):
    return bm25.ranked(dense.best(*_vectors(spark, sf_dir), K), "position", K).select("qid", "id", r6("score").alias("score"), "rank")


@registered(
    f"SELECT qid, id, round(rrf, 9) AS rrf, rank::INT AS rank FROM (SELECT qid, id, coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0), 12) DESC, a NULLS LAST, b NULLS LAST) AS rank FROM fa FULL JOIN fb USING (qid, id)) WHERE rank <= {K}",
    unit=_UNIT,
    dense=_DENSE,
    fa="SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(1 / (1 + abs(id - substr(qid, 2)::BIGINT)), 12) DESC, id) AS a FROM dense",
    fb="SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, id) AS b FROM dense WHERE score > 0",
)
def rrf_hybrid(spark, sf_dir):
    vectors, asked = _vectors(spark, sf_dir)
    near = lambda q, d: 1 / (1 + abs(d - q[:, None]))
    found = dense.fused(vectors, asked.withColumn("other", F.substr("qid", F.lit(2)).cast("bigint")), near, K, strategies.RRF_K)
    return found.select("qid", "id", F.round("rrf", 9).alias("rrf"), "rank")


_BAG = "list_transform(range(16), lambda k: len(list_filter(list_transform(list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: w <> ''), lambda w: ('0x' || right(md5(w), 2))::INT % 16), lambda x: x = k)))::DOUBLE[]"


@registered(
    f"SELECT qid, id, round(rrf, 9) AS rrf, rank::INT AS rank FROM (SELECT qid, id, coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0) AS rrf, row_number() OVER (PARTITION BY qid ORDER BY round(coalesce(1 / (60 + a), 0) + coalesce(1 / (60 + b), 0), 12) DESC, a NULLS LAST, b NULLS LAST) AS rank FROM sparse_rank FULL JOIN dense_rank_ USING (qid, id)) WHERE rank <= {K}",
    sparse_rank="SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, position) AS a FROM store WHERE score > 0",
    bagged=f"SELECT history_id, id, position, {_BAG.format(text='text')} AS d FROM pos",
    asked_bag=f"SELECT qid, history_id, {_BAG.format(text='question')} AS q FROM questions",
    near_=f"SELECT qid, id, position, list_dot_product(q, d) / sqrt(list_dot_product(q, q)) / sqrt(list_dot_product(d, d)) AS score FROM asked_bag JOIN bagged USING (history_id) WHERE list_sum(q) > 0 AND list_sum(d) > 0",
    dense_rank_="SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, position) AS b FROM near_ WHERE score > 0",
)
def hybrid_topk(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    vectors = strategies.placed(turns).select("history_id", "id", "position", parsing.bag_embedding(F.col("text"), 16).alias("v"))
    queries = questions.select("qid", "history_id", parsing.bag_embedding(F.col("question"), 16).alias("v"))
    found = strategies.fused(strategies.store_scores(turns, questions), strategies.dense_scores(vectors, queries))
    return found.where(F.col("rank") <= K).select("qid", "id", F.round("rrf", 9).alias("rrf"), "rank")


@registered("SELECT qid, 'random' AS strategy, id AS turn_id, row_number() OVER (PARTITION BY qid ORDER BY sha256(qid || '|' || id), position)::INT AS unit_ord FROM questions JOIN pos USING (history_id)".replace("FROM questions JOIN", "FROM (SELECT qid, history_id FROM questions) JOIN"))
def random_order(spark, sf_dir):
    return strategies.random_turns(*both(spark, sf_dir)).select("qid", "strategy", "turn_id", "unit_ord")


# Packing

_FOLD = """SELECT qid, budget, 0::BIGINT AS r, 0::BIGINT AS used, []::VARCHAR[] AS heads, NULL::VARCHAR AS took FROM (SELECT DISTINCT qid FROM cand), (VALUES (256), (1024)) AS b(budget)
UNION ALL SELECT f.qid, f.budget, c.rank, CASE WHEN f.used + c.line_tokens + CASE WHEN list_contains(f.heads, c.session_id) THEN 0 ELSE c.header_tokens END <= f.budget THEN f.used + c.line_tokens + CASE WHEN list_contains(f.heads, c.session_id) THEN 0 ELSE c.header_tokens END ELSE f.used END,
  CASE WHEN f.used + c.line_tokens + CASE WHEN list_contains(f.heads, c.session_id) THEN 0 ELSE c.header_tokens END <= f.budget AND NOT list_contains(f.heads, c.session_id) THEN list_append(f.heads, c.session_id) ELSE f.heads END,
  CASE WHEN f.used + c.line_tokens + CASE WHEN list_contains(f.heads, c.session_id) THEN 0 ELSE c.header_tokens END <= f.budget THEN c.id END
  FROM fold f JOIN cand c ON c.qid = f.qid AND c.rank = f.r + 1"""
_CAND = "SELECT r.qid, r.rank, p.* FROM rank_store r JOIN priced p ON p.history_id = r.history_id AND p.id = r.id"
_PACKED = "SELECT f.qid, f.budget, p.*, row_number() OVER (PARTITION BY f.qid, f.budget ORDER BY p.ts, p.session_id, p.seq) AS out_ord, row_number() OVER (PARTITION BY f.qid, f.budget, p.session_id ORDER BY p.seq) AS in_session FROM fold f JOIN cand p ON p.qid = f.qid AND p.id = f.took"


def _packed_store(spark, sf_dir) -> DataFrame:
    turns, questions = both(spark, sf_dir)
    return packing.packed(strategies.store(turns, questions), turns, BUDGETS)


@registered("SELECT qid, budget::INT AS budget, id AS turn_id, out_ord::INT AS out_ord FROM packed", fold=_FOLD, cand=_CAND, packed=_PACKED.replace("p.*", "p.id, p.ts, p.seq, p.session_id"))
def pack_ranked(spark, sf_dir):
    return _packed_store(spark, sf_dir).select("qid", "budget", "turn_id", "out_ord")


@registered(
    "SELECT qid, budget::INT AS budget, string_agg(CASE WHEN in_session = 1 THEN " + o.header("session_id", "ts") + " || chr(10) ELSE '' END || speaker || ': ' || text, chr(10) ORDER BY out_ord) AS body FROM packed GROUP BY 1, 2",
    fold=_FOLD,
    cand=_CAND,
    packed=_PACKED.replace("p.*", "p.id, p.ts, p.seq, p.session_id, p.speaker, p.text"),
)
def render_context(spark, sf_dir):
    return packing.rendered(_packed_store(spark, sf_dir)).select("qid", "budget", "body")


_HEAD = """SELECT *, coalesce(sum(line_tokens + head) OVER (PARTITION BY qid, budget ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT q.qid, b.budget, p.id, p.session_id, p.line_tokens, p.text_tokens, o.rank, CASE WHEN row_number() OVER (PARTITION BY q.qid, b.budget, p.session_id ORDER BY o.rank) = 1 THEN p.header_tokens ELSE 0 END AS head
  FROM (SELECT qid, history_id FROM questions) q, (VALUES (256), (1024)) AS b(budget) JOIN (SELECT history_id AS h, id AS i, position + 1 AS rank FROM pos) o ON o.h = q.history_id
  JOIN (SELECT *, {tokens} AS text_tokens FROM priced) p ON p.history_id = o.h AND p.id = o.i)""".replace("{tokens}", o.tokens("text"))


@registered(
    "SELECT qid, budget::INT AS budget, id AS turn_id, before + line_tokens + head > budget AS cut FROM head h WHERE before + line_tokens + head <= budget OR (rank = (SELECT min(rank) FROM head x WHERE x.qid = h.qid AND x.budget = h.budget AND x.before + x.line_tokens + x.head > x.budget) AND budget - before - head - (line_tokens - text_tokens) >= 8)",
    head=_HEAD,
)
def pack_positional(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return packing.packed_prefix(turns, questions, BUDGETS).select("qid", "budget", "turn_id", "cut")


_RECENT = f"""SELECT * FROM (SELECT *, max(upto) OVER (PARTITION BY qid, budget ORDER BY nth) AS peak, coalesce(max(upto) OVER (PARTITION BY qid, budget ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM (
  SELECT *, sum(line_tokens + head) OVER (PARTITION BY qid, budget ORDER BY nth) AS upto FROM (
    SELECT q.qid, b.budget, b.budget // 4 AS lim, p.*, {o.tokens('p.text')} AS text_tokens, o.nth, p.header_tokens - coalesce(lag(p.header_tokens) OVER (PARTITION BY q.qid, b.budget, p.session_id ORDER BY o.nth), 0) AS head
    FROM (SELECT qid, history_id FROM questions) q, (VALUES (256), (1024)) AS b(budget) JOIN (SELECT history_id AS h, id AS i, n_turns - position AS nth FROM pos) o ON o.h = q.history_id
    JOIN priced p ON p.history_id = o.h AND p.id = o.i))) WHERE low <= lim AND (peak <= lim OR lim - (upto - text_tokens) >= 8)"""
_RECENT_PAID = f"SELECT *, CASE WHEN peak <= lim THEN upto ELSE upto - line_tokens + {o.tokens('(speaker || chr(58) || chr(32) || short)')} END AS paid FROM (SELECT *, {o.truncated('text', '(lim - (upto - text_tokens))')} AS short FROM recent)"
_PRICE = "c.line_tokens + CASE WHEN list_contains(f.heads, c.session_id) THEN 0 ELSE c.header_tokens END"
_SPLIT = f"""SELECT a.qid, a.budget, 0::BIGINT AS r, coalesce(any_value(s.used), 0)::BIGINT AS used, coalesce(any_value(s.heads), [])::VARCHAR[] AS heads, coalesce(any_value(s.ids), [])::VARCHAR[] AS ids
  FROM (SELECT qid, budget FROM (SELECT qid FROM questions) q, (VALUES (256), (1024)) AS b(budget)) a LEFT JOIN (SELECT qid, budget, max_by(paid, nth) AS used, list(DISTINCT session_id) AS heads, list(id) AS ids FROM recent_paid GROUP BY 1, 2) s ON s.qid = a.qid AND s.budget = a.budget GROUP BY 1, 2
UNION ALL SELECT f.qid, f.budget, c.rank, CASE WHEN NOT list_contains(f.ids, c.id) AND f.used + {_PRICE} <= f.budget THEN f.used + {_PRICE} ELSE f.used END,
  CASE WHEN NOT list_contains(f.ids, c.id) AND f.used + {_PRICE} <= f.budget AND NOT list_contains(f.heads, c.session_id) THEN list_append(f.heads, c.session_id) ELSE f.heads END,
  CASE WHEN NOT list_contains(f.ids, c.id) AND f.used + {_PRICE} <= f.budget THEN list_append(f.ids, c.id) ELSE f.ids END
  FROM halves f JOIN cand c ON c.qid = f.qid AND c.rank = f.r + 1"""


@registered(
    "SELECT qid, 'window_bm25' AS strategy, budget::INT AS budget, len(ids)::BIGINT AS n_turns, used::BIGINT AS tokens FROM (SELECT *, row_number() OVER (PARTITION BY qid, budget ORDER BY r DESC) AS back FROM halves) WHERE back = 1 AND len(ids) > 0",
    recent=_RECENT,
    recent_paid=_RECENT_PAID,
    halves=_SPLIT,
    cand=_CAND.replace("rank_store", "rank_turns"),
)
def pack_window_split(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    shown = packing.packed_split(strategies.window_bm25(turns, questions), turns, questions, BUDGETS, 0.25)
    return packing.totals(shown).select("qid", "strategy", "budget", "n_turns", F.col("tokens").cast("bigint").alias("tokens"))


# Facts


@registered("SELECT id, subject, attribute, value, valid_from, superseded_by FROM chain")
def facts_chain(spark, sf_dir):
    return facts.chained(facts.filed_in_order(tables.facts(spark, sf_dir))).select("id", "subject", "attribute", "value", "valid_from", "superseded_by")


@registered("SELECT subject, attribute, arg_max(value, (valid_from, id)) AS value, max(valid_from) AS valid_from FROM facts WHERE valid_from <= TIMESTAMP '2024-01-15' GROUP BY 1, 2".replace("arg_max(value, (valid_from, id))", "arg_max(value, valid_from)"))
def facts_as_of(spark, sf_dir):
    held = facts.as_of(facts.filed_in_order(tables.facts(spark, sf_dir)), F.lit("2024-01-15").cast("timestamp_ntz"))
    return held.select("subject", "attribute", "value", "valid_from")


@registered(
    "SELECT p.probe_id, p.subject, p.attribute, f.value, f.valid_from FROM probes p ASOF LEFT JOIN facts f ON p.subject = f.subject AND p.attribute = f.attribute AND p.at >= f.valid_from",
    probes="SELECT event_id AS probe_id, 'user_' || user_id AS subject, event_type AS attribute, ts - INTERVAL 1 DAY AS at FROM events",
)
def facts_as_of_each(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events")
    probes = e.select(F.col("event_id").alias("probe_id"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("subject"), F.col("event_type").alias("attribute"), (F.col("ts").cast("timestamp_ntz") - F.make_dt_interval(F.lit(1))).alias("at"))
    return facts.as_of_each(facts.filed_in_order(tables.facts(spark, sf_dir)), probes).select("probe_id", "subject", "attribute", "value", "valid_from")


@registered("SELECT subject, attribute, value, subject || ' / ' || attribute || ': ' || value || ' (since ' || strftime(valid_from, '%Y-%m-%d') || ')' AS line FROM chain WHERE superseded_by IS NULL")
def facts_current(spark, sf_dir):
    return facts.current(facts.filed_in_order(tables.facts(spark, sf_dir))).select("subject", "attribute", "value", facts.rendered().alias("line"))


_LATE = "SELECT row_number() OVER (PARTITION BY user_id, event_type ORDER BY md5(event_id::VARCHAR)) AS id, event_id, 'user_' || user_id AS subject, event_type AS attribute, floor(value / 10)::BIGINT::VARCHAR AS value, ts AS valid_from FROM events"


@registered(
    "SELECT event_id, subject, attribute, value, valid_from FROM late WHERE id IN (SELECT unnest(kept) FROM filing f WHERE f.subject = late.subject AND f.attribute = late.attribute AND n = (SELECT max(id) FROM late x WHERE x.subject = late.subject AND x.attribute = late.attribute))",
    late=_LATE,
    filing="""SELECT subject, attribute, 0::BIGINT AS n, []::BIGINT[] AS kept, []::STRUCT(t TIMESTAMP, id BIGINT, v VARCHAR)[] AS versions FROM (SELECT DISTINCT subject, attribute FROM late)
UNION ALL SELECT f.subject, f.attribute, l.id, CASE WHEN list_last(list_sort(list_filter(f.versions, lambda v: v.t <= l.valid_from))).v IS DISTINCT FROM l.value THEN list_append(f.kept, l.id) ELSE f.kept END,
  CASE WHEN list_last(list_sort(list_filter(f.versions, lambda v: v.t <= l.valid_from))).v IS DISTINCT FROM l.value THEN list_append(f.versions, {'t': l.valid_from, 'id': l.id, 'v': l.value}) ELSE f.versions END
  FROM filing f JOIN late l ON l.subject = f.subject AND l.attribute = f.attribute AND l.id = f.n + 1""",
)
def facts_late_arrivals(spark, sf_dir):
    return facts.filed(tables.facts(spark, sf_dir, late=True)).select("event_id", "subject", "attribute", "value", "valid_from")


_HELD = "SELECT subject, attribute, arg_max(value, valid_from) AS value, arg_max(source_turn, valid_from) AS source_turn, min(valid_from) AS first FROM facts WHERE valid_from <= TIMESTAMP '2024-01-15' GROUP BY 1, 2"


@registered(
    "SELECT qid, subject, attribute, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, doc_id) AS rank FROM (SELECT s.*, h.*, max(score) OVER (PARTITION BY qid) AS top FROM fscore s JOIN held2 h ON h.k = s.doc_id) WHERE score >= 0.5 * top) WHERE rank <= 20",
    held=_HELD,
    held2=f"SELECT *, subject || '|' || attribute AS k, {o.terms(chr(40) + 'subject || chr(32) || attribute || chr(32) || value || chr(32) || coalesce(text, chr(32))' + chr(41))} AS ts_ FROM held LEFT JOIN turns ON turns.id = source_turn",
    fdocs="SELECT 0::BIGINT AS history_id, k AS doc_id, ts_ FROM held2",
    qterms=f"SELECT DISTINCT 'q' || user_id AS qid, 0::BIGINT AS history_id, unnest({o.terms(chr(40) + quote + chr(41))}) AS term FROM events" if (quote := "'did user_' || user_id || ' click or purchase'") else "",
    fscore=o._bm25("fdocs"),
)
def facts_relevant(spark, sf_dir):
    held = facts.as_of(facts.filed_in_order(tables.facts(spark, sf_dir)), F.lit("2024-01-15").cast("timestamp_ntz"))
    said = tables.turns(spark, sf_dir).select(F.col("id").alias("source_turn"), "text")
    asked = tables.table(spark, sf_dir, "events").select("user_id").distinct()
    q = asked.select(F.concat(F.lit("q"), F.col("user_id").cast("string")).alias("qid"), F.concat(F.lit("did user_"), F.col("user_id").cast("string"), F.lit(" click or purchase")).alias("question"))
    return memory.relevant_facts(held, said, q).select("qid", "subject", "attribute", r6("score").alias("score"), "rank")


_EACH = "'did user_' || user_id || ' click or purchase'"


@registered(
    "SELECT qid, subject, attribute, value, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, first, doc_id) AS rank FROM (SELECT s.*, h.* EXCLUDE (qid), max(score) OVER (PARTITION BY s.qid) AS top FROM escore s JOIN eheld2 h ON h.k = s.doc_id AND h.qid = s.qid) WHERE score >= 0.5 * top) WHERE rank <= 20",
    eq=f"SELECT DISTINCT 'q' || user_id AS qid, {_EACH} AS question, TIMESTAMP '2024-01-03' + to_hours((user_id * 7 % 480)::INT) AS now FROM events",
    eheld="SELECT qid, q.now, subject, attribute, arg_max(value, valid_from) AS value, arg_max(source_turn, valid_from) AS source_turn, min(valid_from) AS first FROM eq q JOIN facts f ON f.valid_from <= q.now GROUP BY ALL",
    eheld2=f"SELECT h.*, subject || '|' || attribute AS k, {o.terms(chr(40) + 'subject || chr(32) || attribute || chr(32) || value || chr(32) || coalesce(text, chr(32))' + chr(41))} AS ts_ FROM eheld h LEFT JOIN turns t ON t.id = h.source_turn AND t.ts <= h.now",
    edocs="SELECT qid, 0::BIGINT AS history_id, k AS doc_id, ts_ FROM eheld2",
    qterms=f"SELECT DISTINCT 'q' || user_id AS qid, 0::BIGINT AS history_id, unnest({o.terms(chr(40) + _EACH + chr(41))}) AS term FROM events",
    escore=o.bm25_by_question("edocs"),
)
def facts_relevant_each(spark, sf_dir):
    """The facts relevant to a question about each user, as of a time of its own."""
    asked = tables.table(spark, sf_dir, "events").select("user_id").distinct()
    name = F.col("user_id").cast("string")
    now = F.lit("2024-01-03").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (F.col("user_id") * 7 % 480).cast("int"))
    q = asked.select(F.concat(F.lit("q"), name).alias("qid"), F.concat(F.lit("did user_"), name, F.lit(" click or purchase")).alias("question"), now.alias("now"))
    found = memory.relevant_facts_each(facts.filed_in_order(tables.facts(spark, sf_dir)), tables.turns(spark, sf_dir), q)
    return found.select("qid", "subject", "attribute", "value", r6("score").alias("score"), "rank")


@registered()
def store_context(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    found = memory.contexts(turns, facts.filed_in_order(tables.facts(spark, sf_dir)), questions, now, 512)
    return found.select("qid", F.col("tokens").cast("bigint").alias("tokens"), "body")


# The store


def _stored(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an empty store holds after the even turns of each conversation, and a batch of all turns."""
    t = tables.turns(spark, sf_dir)
    batch = t.select(F.struct("ts", "seq").alias("input_ord"), F.lit(0).alias("session_ord"), "id", "session_id", "session_ts", "speaker", "text", "ts")
    none = t.limit(0).select("id", "session_id", F.col("seq").cast("bigint").alias("seq"), "speaker", "text", "ts", F.lit(None).cast("timestamp_ntz").alias("forgotten_at"))
    sessions = t.limit(0).select(F.col("session_id").alias("id"), F.col("ts").alias("started_at"), F.col("seq").alias("next_seq"))
    stored, known, _ = store.ingested(none, sessions, batch.where("input_ord.seq % 2 = 0"))
    return stored, known, batch


@registered("SELECT id, session_id, CASE WHEN seq % 2 = 0 THEN seq // 2 ELSE seq // 2 + (SELECT count(*) FROM turns x WHERE x.session_id = t.session_id AND x.seq % 2 = 0) END::BIGINT AS seq FROM turns t")
def ingest_dedupe(spark, sf_dir):
    stored, known, batch = _stored(spark, sf_dir)
    return store.ingested(stored, known, batch)[0].select("id", "session_id", "seq")


@registered("SELECT count_if(seq % 2 = 1)::BIGINT AS added, count_if(seq % 2 = 0)::BIGINT AS already_stored, 0::BIGINT AS empty FROM turns")
def ingest_counts(spark, sf_dir):
    stored, known, batch = _stored(spark, sf_dir)
    return store.ingested(stored, known, batch)[2]


def _policy(spec: str) -> Query:
    def run(spark, sf_dir):
        t = tables.turns(spark, sf_dir).withColumn("forgotten_at", F.lit(None).cast("timestamp_ntz"))
        now = F.lit("2024-02-15").cast("timestamp_ntz")
        return store.forgotten(t, store.policy(spec, now)[0], now).select("id", F.col("forgotten_at").isNotNull().alias("forgotten"))

    return run


@registered(f"SELECT id, len({o.terms('text')}) < 12 AS forgotten FROM turns")
def forget_phatic(spark, sf_dir):
    return _policy("phatic:12")(spark, sf_dir)


@registered("SELECT id, speaker = 'assistant' AS forgotten FROM turns")
def forget_role(spark, sf_dir):
    return _policy("role:assistant")(spark, sf_dir)


@registered("SELECT id, ts < TIMESTAMP '2024-02-15' - INTERVAL 20 DAY - INTERVAL 12 HOUR AS forgotten FROM turns")
def forget_older_than(spark, sf_dir):
    return _policy("older-than:20.5")(spark, sf_dir)


@registered(f"SELECT id, {o.truncated('text', 48)} AS text, {o.tokens('text')} > 48 AS changed FROM turns")
def compact_truncate(spark, sf_dir):
    t = tables.turns(spark, sf_dir).withColumn("forgotten_at", F.lit(None).cast("timestamp_ntz"))
    return store.compacted(t, 48).select("id", "text", "changed")


@registered("SELECT f.id, CASE WHEN t.id IS NULL THEN source_turn END AS source_turn FROM facts f LEFT JOIN (SELECT id FROM turns WHERE speaker = 'user') t ON t.id = source_turn")
def purge(spark, sf_dir):
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    t = tables.turns(spark, sf_dir).withColumn("forgotten_at", F.lit(None).cast("timestamp_ntz"))
    return store.purged(store.forgotten(t, store.by_speaker("user"), now), facts.filed_in_order(tables.facts(spark, sf_dir)))[1].select("id", "source_turn")


@registered("SELECT (SELECT count(DISTINCT session_id) FROM turns)::BIGINT AS sessions, (SELECT count(*) FROM turns WHERE speaker <> 'user')::BIGINT AS turns, (SELECT count(*) FROM turns WHERE speaker = 'user')::BIGINT AS forgotten_turns, (SELECT count(*) FROM chain WHERE superseded_by IS NULL)::BIGINT AS facts_current, (SELECT count(*) FROM chain WHERE superseded_by IS NOT NULL)::BIGINT AS facts_superseded")
def store_stats(spark, sf_dir):
    now = F.lit("2024-02-15").cast("timestamp_ntz")
    t = tables.turns(spark, sf_dir).withColumn("forgotten_at", F.lit(None).cast("timestamp_ntz"))
    return store.stats(store.forgotten(t, store.by_speaker("user"), now), t.select("session_id").distinct(), facts.chained(facts.filed_in_order(tables.facts(spark, sf_dir))))


@registered("SELECT history_id, count(*)::BIGINT AS turns, min(position)::BIGINT AS first, max(position)::BIGINT AS last FROM (SELECT *, row_number() OVER (PARTITION BY history_id ORDER BY ts, session_id, seq) - 1 AS position FROM turns WHERE ts <= TIMESTAMP '2024-02-15') GROUP BY 1")
def history_at(spark, sf_dir):
    seen = store.history_at(tables.turns(spark, sf_dir), F.lit("2024-02-15").cast("timestamp_ntz"))
    return strategies.placed(seen).groupBy("history_id").agg(F.count("*").alias("turns"), F.min("position").cast("bigint").alias("first"), F.max("position").cast("bigint").alias("last"))


# Files: tables written out and read again


def _written(spark, name: str) -> str:
    return f"{kept_folder(spark)}/{name}-{uuid.uuid4().hex}"


@registered("SELECT session_id, min(ts) OVER (PARTITION BY session_id) AS session_ts, speaker, text, ts, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS seq FROM (SELECT * REPLACE (ts + to_minutes(seq::INT) AS ts) FROM turns)")
def jsonl_turns(spark, sf_dir):
    """The turns as JSON lines, a session's in one file, read as ``read_jsonl`` does."""
    turns = tables.turns(spark, sf_dir)
    when = F.date_format(F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("seq").cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    path = _written(spark, "turns")
    rows = turns.repartition("session_id").sortWithinPartitions("session_id", "seq")
    rows.select(F.col("session_id").alias("session"), when.alias("time"), "speaker", "text").write.json(path)
    return files.read_jsonl(spark, path).select("session_id", "session_ts", "speaker", "text", "ts", F.col("seq").cast("bigint").alias("seq"))


def _dialogue_file(spark, sf_dir) -> str:
    """A file for each history: an array of one dialogue, its conversations as numbered sessions."""
    t = tables.turns(spark, sf_dir).withColumn("n", F.dense_rank().over(Window.partitionBy("history_id").orderBy(F.col("session_id").cast("bigint"))))
    line = F.struct(F.col("seq"), F.struct(F.col("speaker"), F.concat(F.lit("D"), F.col("n").cast("string"), F.lit(":"), F.col("seq").cast("string")).alias("dia_id"), F.col("text")).alias("t"))
    one = t.groupBy("history_id", "n").agg(F.min("ts").alias("ts"), F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]).alias("said"))
    parts = F.concat(F.lit('"session_'), F.col("n").cast("string"), F.lit('": '), F.to_json("said"), F.lit(', "session_'), F.col("n").cast("string"), F.lit('_date_time": "'), F.date_format("ts", "h:mm a 'on' d MMMM, yyyy"), F.lit('"'))
    q = tables.questions(spark, sf_dir).withColumn("conv", F.substr("qid", F.lit(2)).cast("bigint"))
    known = t.select(F.col("id").alias("turn_id"), F.concat(F.lit("D"), F.col("n").cast("string"), F.lit(":"), F.lpad(F.col("seq").cast("string"), 3, "0")).alias("e"))
    asked = q.join(known, "turn_id").select("history_id", F.struct("conv", F.struct("question", "answer", F.array("e").alias("evidence"), (F.col("conv") % 4 + 1).alias("category")).alias("q")).alias("q"))
    qa = asked.groupBy("history_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list("q")), lambda x: x["q"])).alias("qa"))
    whole = one.groupBy("history_id").agg(F.array_join(F.sort_array(F.collect_list(parts)), ", ").alias("sessions")).join(qa, "history_id")
    text_ = F.concat(F.lit('[{"sample_id": "c'), F.col("history_id").cast("string"), F.lit('", "conversation": {'), "sessions", F.lit('}, "qa": '), "qa", F.lit("}]"))
    path = _written(spark, "dialogues")
    whole.select(text_.alias("value"), "history_id").write.partitionBy("history_id").text(path)
    return path


_NUMBERED = "SELECT *, dense_rank() OVER (PARTITION BY history_id ORDER BY session_id::BIGINT) AS n FROM turns"


@registered("SELECT 'c' || history_id AS history_id, 'c' || history_id || ':D' || n || ':' || seq AS id, 'c' || history_id || ':S' || n AS session_id, speaker, text, ts, row_number() OVER (PARTITION BY history_id, n ORDER BY seq) - 1 AS seq FROM numbered", numbered=_NUMBERED)
def dialogue_turns(spark, sf_dir):
    found = files.read_dialogues(spark, _dialogue_file(spark, sf_dir))
    return found.turns.select("history_id", "id", "session_id", "speaker", "text", "ts", F.col("seq").cast("bigint").alias("seq"))


@registered(
    "SELECT 'c' || q.history_id || ':q' || (row_number() OVER (PARTITION BY q.history_id ORDER BY substr(qid, 2)::BIGINT) - 1) AS qid, question, answer, ['multi-hop', 'temporal', 'open-domain', 'single-hop'][substr(qid, 2)::BIGINT % 4 + 1] AS qtype, max(t.last) AS now, 'c' || q.history_id || ':D' || any_value(n) || ':' || any_value(e.seq) AS turn_id FROM questions q JOIN numbered e ON e.id = q.turn_id JOIN (SELECT history_id, max(ts) AS last FROM turns GROUP BY 1) t ON t.history_id = q.history_id GROUP BY q.history_id, qid, question, answer",
    numbered=_NUMBERED,
)
def dialogue_questions(spark, sf_dir):
    """Their evidence ids are written with zeros before them, and repaired."""
    found = files.read_dialogues(spark, _dialogue_file(spark, sf_dir))
    return found.questions.select("qid", "question", "answer", "qtype", "now").join(found.evidence.select("qid", "turn_id"), "qid")


@registered("SELECT count(*)::BIGINT AS evidence_strings, count(*) FILTER (e.seq >= 100)::BIGINT AS exact, count(*) FILTER (e.seq < 100)::BIGINT AS repaired, 0::BIGINT AS unresolvable FROM questions q JOIN turns e ON e.id = q.turn_id")
def dialogue_audit(spark, sf_dir):
    return files.evidence_audit(spark, _dialogue_file(spark, sf_dir))


# Evaluation and reports


def eval_rows(spark, sf_dir) -> DataFrame:
    """One row for each question, strategy and number of hits: what the first hits bring.

    Both strategies rank one search. Questions and contexts are read from several sides, so they are
    written once rather than made again in each branch of the plan.
    """
    turns, questions = both(spark, sf_dir)
    questions = kept(questions, "questions")
    found = strategies.grid_scores(strategies.score_parts(turns, questions), [strategies.Config()])
    wide = found.select("qid", "id", "session_id", "position", F.inline(F.array(F.struct(F.lit("bm25_turns").alias("strategy"), F.col("raw").alias("score")), F.struct(F.lit("store").alias("strategy"), F.col("score").alias("score")))))
    order = Window.partitionBy("qid", "strategy").orderBy(F.round("score", 12).desc(), "position")
    ranked = wide.withColumn("rank", F.row_number().over(order)).where("rank <= 5")
    ks = ranked.select("*", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("budget")).where("rank <= budget")
    contexts = kept(ks.select("qid", "strategy", "budget", F.col("id").alias("turn_id"), "session_id", (F.col("rank") == 5).alias("cut")), "contexts")
    tokens = contexts.join(turns.select(F.col("id").alias("turn_id"), text.count_tokens(F.col("text")).alias("t")), "turn_id").groupBy("qid", "strategy", "budget").agg(F.sum("t").alias("tokens"))
    scored = evaluation.scores(contexts, questions, questions.select("qid", "history_id", "turn_id"), questions.select("qid", "session_id"), turns)
    wide = scored.join(questions.select("qid", "dataset", "cluster", "split"), "qid").join(tokens, ["qid", "strategy", "budget"], "left")
    return kept(wide.withColumn("tokens", F.coalesce("tokens", F.lit(0))), "scored")


_EVAL = {
    "hits": f"SELECT qid, 'bm25_turns' AS strategy, id, session_id, rank, {'t'}.tokens FROM rank_turns r JOIN (SELECT id AS i, {o.tokens('text')} AS tokens FROM turns) t ON t.i = r.id WHERE rank <= 5 UNION ALL SELECT qid, 'store', id, session_id, rank, t.tokens FROM rank_store r JOIN (SELECT id AS i, {o.tokens('text')} AS tokens FROM turns) t ON t.i = r.id WHERE rank <= 5",
    "grid": "SELECT q.*, s.strategy, b.budget FROM questions q, (VALUES ('bm25_turns'), ('store')) AS s(strategy), (VALUES (1), (3), (5)) AS b(budget)",
    "rows_": """SELECT g.qid, g.strategy, g.budget::INT AS budget, g.dataset, g.split, g.cluster, g.qtype, coalesce(sum(h.tokens), 0)::BIGINT AS tokens,
  coalesce(max(CASE WHEN h.id = g.turn_id THEN 1.0 END), 0)::DOUBLE AS recall, coalesce(max(CASE WHEN h.id = g.turn_id AND h.rank <> 5 THEN 1.0 END), 0)::DOUBLE AS recall_strict,
  coalesce(max(CASE WHEN h.session_id = g.session_id THEN 1.0 END), 0)::DOUBLE AS session_recall
  FROM grid g LEFT JOIN hits h ON h.qid = g.qid AND h.strategy = g.strategy AND h.rank <= g.budget GROUP BY ALL""",
}


@registered(
    "SELECT qid, strategy, budget, recall, recall_strict, recall = 1 AS \"all\", session_recall, session_recall = 1 AS all_sessions, CASE WHEN qtype = 'knowledge-update' THEN recall = 1 END AS newest, CASE WHEN qtype = 'knowledge-update' THEN false END AS stale_only FROM rows_",
    **_EVAL,
)
def score_recall(spark, sf_dir):
    return eval_rows(spark, sf_dir).select("qid", "strategy", "budget", "recall", "recall_strict", "all", "session_recall", "all_sessions", "newest", "stale_only")


@registered("SELECT dataset, split, strategy, budget, CASE WHEN grouping(qtype) = 1 THEN 'all types' ELSE qtype END AS qtype, count(*)::BIGINT AS n_questions, round(avg(tokens), 1) AS mean_tokens, count(*)::BIGINT AS n_measurable FROM rows_ GROUP BY GROUPING SETS ((dataset, split, strategy, budget, qtype), (dataset, split, strategy, budget))", **_EVAL)
def summarise_rollup(spark, sf_dir):
    return reports.summarise(eval_rows(spark, sf_dir))


_TYPED = "SELECT * REPLACE (unnest([qtype, 'all types']) AS qtype), recall AS value FROM rows_"
_R4 = "round(mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi, n, clusters"


@registered(f"SELECT dataset, split, strategy, budget, qtype, {_R4} FROM ({o.jackknife('typed', 'dataset, split, strategy, budget, qtype')})", typed=_TYPED, **_EVAL)
def jackknife_ci(spark, sf_dir):
    return reports.metric_means(eval_rows(spark, sf_dir), metrics=("recall",)).drop("metric")


_PAIRS = "SELECT dataset, unnest([qtype, 'all types']) AS qtype, cluster, x - y AS value FROM (SELECT dataset, qid, qtype, cluster, max(CASE WHEN strategy = 'store' THEN recall END) AS x, max(CASE WHEN strategy = 'bm25_turns' THEN recall END) AS y FROM rows_ WHERE budget = 3 AND split = 'test' GROUP BY ALL)"


@registered(f"SELECT dataset, qtype, {_R4} FROM ({o.jackknife('pairs', 'dataset, qtype')})", pairs=_PAIRS, **_EVAL)
def paired_compare(spark, sf_dir):
    return reports.compare(eval_rows(spark, sf_dir), "store", "bm25_turns", 3)


@registered("SELECT dataset, split, strategy, qtype, min(CASE WHEN m >= 0.8 THEN budget END) AS budget FROM (SELECT dataset, split, strategy, budget, qtype, round(avg(value), 4) AS m FROM typed GROUP BY ALL) GROUP BY ALL", typed=_TYPED, **_EVAL)
def budget_to_reach(spark, sf_dir):
    return reports.budget_to_reach(reports.metric_means(eval_rows(spark, sf_dir), metrics=("recall",)), 0.8)


def evidence_rows(spark, sf_dir) -> DataFrame:
    """For each gold turn, strategy and budget: where it stands, and whether it was found, and whole."""
    turns, questions = both(spark, sf_dir)
    at = evaluation.positions(questions.select("qid", "history_id", "turn_id"), turns)
    rows = eval_rows(spark, sf_dir).join(at, "qid")
    return rows.withColumn("hit", F.col("recall") > 0).withColumn("whole", F.col("recall_strict") > 0)


_BUCKET = "CASE WHEN pos < 0.25 THEN '0-0.25' WHEN pos < 0.5 THEN '0.25-0.5' WHEN pos < 0.75 THEN '0.5-0.75' WHEN pos < 0.9 THEN '0.75-0.9' ELSE '0.9-1' END"
_AT = {"stood": f"SELECT q.qid, {_BUCKET} AS position FROM (SELECT qid, history_id AS h, turn_id FROM questions) q JOIN (SELECT history_id AS h, id, round(position / greatest(n_turns - 1, 1), 4) AS pos FROM pos) p ON p.h = q.h AND p.id = q.turn_id"}


@registered(f"SELECT dataset, strategy, position, {_R4} FROM ({o.jackknife('placed', 'dataset, strategy, position')})", placed="SELECT r.dataset, r.strategy, r.cluster, stood.position, recall AS value FROM rows_ r JOIN stood USING (qid) WHERE budget = 3 AND split = 'test'", **_AT, **_EVAL)
def by_position(spark, sf_dir):
    return reports.by_position(evidence_rows(spark, sf_dir), 3)


@registered(
    f"SELECT dataset, position, credit, {_R4} FROM ({o.jackknife('placed', 'dataset, position, credit')})",
    placed="SELECT r.dataset, r.cluster, stood.position, c.credit, max(CASE WHEN strategy = 'store' THEN CASE c.credit WHEN 'strict' THEN recall_strict ELSE recall END END) - max(CASE WHEN strategy = 'bm25_turns' THEN CASE c.credit WHEN 'strict' THEN recall_strict ELSE recall END END) AS value FROM rows_ r JOIN stood USING (qid), (VALUES ('lenient'), ('strict')) AS c(credit) WHERE budget = 5 AND split = 'test' GROUP BY r.dataset, r.cluster, stood.position, c.credit, r.qid",
    **_AT,
    **_EVAL,
)
def position_differences(spark, sf_dir):
    return reports.position_differences(evidence_rows(spark, sf_dir), "store", "bm25_turns", 5)


@registered(
    f"SELECT j.dataset, j.strategy, j.qtype, n, unparsed, round(mean, 4) AS mean, round(lo, 4) AS lo, round(hi, 4) AS hi, found_mean, found_n, missing_mean, missing_n FROM ({o.jackknife('answers', 'dataset, strategy, qtype')}) j JOIN (SELECT dataset, strategy, qtype, count_if(correct IS NULL)::BIGINT AS unparsed, round(avg(CASE WHEN recall > 0 THEN value END), 4) AS found_mean, count(CASE WHEN recall > 0 THEN value END)::BIGINT AS found_n, round(avg(CASE WHEN recall = 0 THEN value END), 4) AS missing_mean, count(CASE WHEN recall = 0 THEN value END)::BIGINT AS missing_n FROM answers GROUP BY ALL) s USING (dataset, strategy, qtype)",
    answers="SELECT dataset, strategy, unnest([qtype, 'all types']) AS qtype, cluster, recall, correct, CASE WHEN correct THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM (SELECT *, CASE length(qid) + budget WHEN 3 THEN NULL ELSE recall = 1 END AS correct FROM rows_)",
    **_EVAL,
)
def summarise_answers(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("correct", F.when(F.length("qid") + F.col("budget") != 3, F.col("recall") == 1))
    return reports.summarise_answers(rows)


@registered("SELECT q.qid, q.turn_id, len(list_intersect(list_filter(qt, lambda w: NOT list_contains(names, w)), tt)) > 0 AS visible FROM (SELECT qid, history_id AS h, turn_id, " + o.terms("question") + " AS qt FROM questions) q JOIN (SELECT id, " + o.terms("text") + " AS tt FROM turns) t ON t.id = q.turn_id JOIN (SELECT history_id AS h, flatten(list(DISTINCT " + o.terms("speaker") + ")) AS names FROM turns GROUP BY 1) n ON n.h = q.h")
def lexical_visibility(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return evaluation.visibility(questions, questions.select("qid", "history_id", "turn_id"), turns)


_LOCATED = f"SELECT qid, list_filter(list_distinct(a), lambda w: NOT list_contains(tt, w)) AS missing FROM (SELECT qid, turn_id, {o.terms('answer')} AS a FROM questions) JOIN (SELECT id, {o.terms('text')} AS tt FROM turns) t ON t.id = turn_id WHERE len(a) > 0"


@registered(
    "SELECT qid, CASE WHEN len(missing) = 0 THEN 'in_text' WHEN len(list_filter(missing, lambda w: NOT regexp_full_match(w, '[0-9]+') OR length(w) = 4)) > 0 AND len(list_filter(missing, lambda w: NOT (regexp_full_match(w, '[0-9]+') OR list_contains(dw, w) OR regexp_full_match(rtrim(w, 'thsndr'), '[0-9]+')))) = 0 THEN 'needs_date' ELSE 'elsewhere' END AS location FROM located, dates",
    located=_LOCATED,
    dates=f"SELECT {o.date_words()} AS dw",
)
def answer_location(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return evaluation.answer_location(questions, questions.select("qid", "history_id", "turn_id"), turns)


@registered("SELECT qid, contains(lower(text), lower(answer)) AS present FROM (SELECT qid, turn_id, answer FROM questions) q JOIN (SELECT id, text FROM turns) t ON t.id = q.turn_id")
def answer_present(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return evaluation.answer_present(questions, questions.select("qid", "history_id", "turn_id"), turns)


@registered(f"SELECT qid, coalesce(w IS NOT NULL, false) AS names_time, {o.tokens('question')} AS tokens FROM windows JOIN (SELECT qid, question FROM questions) q USING (qid)")
def names_a_time(spark, sf_dir):
    q = tables.questions(spark, sf_dir)
    return q.select("qid", temporal.query_window(F.col("question"), F.col("now")).isNotNull().alias("names_time"), text.count_tokens(F.col("question")).cast("bigint").alias("tokens"))


@registered("SELECT qid, qtype FROM (SELECT qid, qtype, row_number() OVER (PARTITION BY dataset, qtype ORDER BY md5('7|' || qid), qid) AS nth FROM questions) WHERE nth <= 5")
def question_sample(spark, sf_dir):
    return evaluation.sampled_by_type(tables.questions(spark, sf_dir), 5, 7).select("qid", "qtype")


@registered("SELECT q.qid, round(position / (n_turns - 1), 6) AS mean_pos FROM (SELECT qid, history_id AS h, turn_id FROM questions) q JOIN pos ON pos.history_id = q.h AND pos.id = q.turn_id WHERE n_turns > 1")
def mean_position(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return evaluation.mean_positions(questions.select("qid", "history_id", "turn_id"), turns).select("qid", r6("mean_pos").alias("mean_pos"))


@registered(
    f"SELECT history_id, {'sum'}(t)::BIGINT AS tokens, count(*)::BIGINT AS turns, round((epoch_us(max(ts) + INTERVAL 1 DAY) - epoch_us(min(ts))) / 86400000000.0, 1) AS span_days FROM (SELECT history_id, ts, {o.tokens('text')} AS t FROM turns) GROUP BY 1"
)
def history_diagnostics(spark, sf_dir):
    t = tables.turns(spark, sf_dir)
    day = F.make_dt_interval(F.lit(1))
    return t.groupBy("history_id").agg(F.sum(text.count_tokens(F.col("text"))).cast("bigint").alias("tokens"), F.count("*").alias("turns"), F.round(strategies.age_days(F.max("ts") + day, F.min("ts")), 1).alias("span_days"))


@registered(
    "SELECT config, round(macro, 4) AS macro, config = (SELECT config FROM macro_ ORDER BY round(macro, 4) DESC, config LIMIT 1) AS best FROM macro_",
    macro_="SELECT config, avg(recall) AS macro FROM (SELECT config, dataset, round(avg(recall), 4) AS recall FROM (SELECT *, budget * 10 + CASE strategy WHEN 'store' THEN 1 ELSE 0 END AS config FROM rows_ WHERE split = 'dev') GROUP BY ALL) GROUP BY 1",
    **_EVAL,
)
def sweep_best(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).where("split = 'dev'").withColumn("config", F.col("budget") * 10 + (F.col("strategy") == "store").cast("int"))
    return reports.best_config(rows.select("config", "dataset", "recall"))


@registered()
def bootstrap_ci(spark, sf_dir):
    rows = eval_rows(spark, sf_dir).withColumn("value", F.col("recall"))
    return stats.bootstrap(rows, ["dataset", "split", "strategy", "budget"], resamples=200)


POLICIES = ("none", "phatic:12", "truncate:16", "role:assistant", "older-than:5")
_KEPT = f"""SELECT 'none' AS policy, * FROM turns UNION ALL SELECT 'phatic:12', * FROM turns WHERE len({o.terms('text')}) >= 12
UNION ALL SELECT 'truncate:16', * REPLACE ({o.truncated('text', 16)} AS text) FROM turns UNION ALL SELECT 'role:assistant', * FROM turns WHERE speaker <> 'assistant'
UNION ALL SELECT 'older-than:5', turns.* FROM turns JOIN (SELECT DISTINCT history_id AS h, now FROM questions) n ON n.h = history_id WHERE ts >= now - INTERVAL 5 DAY"""
_STUDY = {
    "kept": _KEPT,
    "asked_": f"SELECT p.policy, questions.* FROM questions, (VALUES {', '.join(f'({o.quoted(x)})' for x in POLICIES)}) AS p(policy)",
    "qterms": f"SELECT DISTINCT policy || ':' || qid AS qid, policy || '|' || history_id AS history_id, unnest({o.terms('question')}) AS term FROM asked_",
    "kdocs": f"SELECT policy || '|' || history_id AS history_id, id AS doc_id, {o.terms(chr(40) + 'speaker || ' + o.quoted(' ') + ' || text' + chr(41))} AS ts_ FROM kept",
    "kscore": o._bm25("kdocs"),
    "khits": "SELECT qid, doc_id FROM (SELECT s.qid, s.doc_id, row_number() OVER (PARTITION BY s.qid ORDER BY round(s.score, 12) DESC, p.position) AS rank FROM kscore s JOIN pos p ON p.id = s.doc_id) WHERE rank <= 5",
    "ksize": f"SELECT k.policy, k.history_id, k.t / a.t AS share FROM (SELECT policy, history_id, sum({o.tokens('text')}) AS t FROM kept GROUP BY 1, 2) k JOIN (SELECT history_id, sum({o.tokens('text')}) AS t FROM turns GROUP BY 1) a USING (history_id)",
    "studied": """SELECT a.policy, a.dataset, a.qtype, a.cluster, a.qid, coalesce(z.share, 0) AS tokens_kept, CASE WHEN k.id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS evidence_kept, CASE WHEN h.qid IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS recall,
  CASE WHEN contains(lower(t.text), lower(a.answer)) THEN CASE WHEN k.id IS NOT NULL AND contains(lower(k.text), lower(a.answer)) THEN 1.0 ELSE 0.0 END::DOUBLE END AS answer_kept
  FROM asked_ a JOIN turns t ON t.id = a.turn_id LEFT JOIN kept k ON k.policy = a.policy AND k.id = a.turn_id LEFT JOIN khits h ON h.qid = a.policy || ':' || a.qid AND h.doc_id = a.turn_id LEFT JOIN ksize z ON z.policy = a.policy AND z.history_id = a.history_id""",
}


def study_rows(spark, sf_dir, policies: tuple[str, ...] | None = None) -> DataFrame:
    """For each question and policy: what is kept of the history, the evidence and the answer, and
    whether the first five hits hold the evidence.

    A policy's turns are histories of their own, so all policies share one index and one search.
    ``policies``: names that ``store.policy`` knows, and none.
    """
    policies = policies or POLICIES
    turns, questions = both(spark, sf_dir)
    now = turns.join(questions.select("history_id", "now").distinct(), "history_id")
    parts = [store.applied(now, *((None, None) if p == "none" else store.policy(p, F.col("now")))).withColumn("policy", F.lit(p)) for p in policies]
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.unionByName(part)
    kept = kept.drop("now")
    whose = F.concat(F.col("policy"), F.lit("|"), F.col("history_id").cast("string"))
    asked = questions.select("*", F.explode(F.array(*map(F.lit, policies))).alias("policy")).withColumn("asked", F.col("qid")).withColumn("qid", F.concat("policy", F.lit(":"), "qid"))
    hits = bm25.ranked(strategies.turn_scores(kept.withColumn("history_id", whose), asked.withColumn("history_id", whose)), "position", 5).select("qid", F.col("id").alias("turn_id"), F.lit(1.0).alias("hit"))
    cost = F.sum(text.count_tokens(F.col("text")))
    share = kept.groupBy("policy", "history_id").agg(cost.alias("t")).join(turns.groupBy("history_id").agg(cost.alias("all")), "history_id").select("policy", "history_id", (F.col("t") / F.col("all")).alias("tokens_kept"))
    gold = turns.select(F.col("id").alias("turn_id"), F.lower("text").alias("said"))
    left = kept.select("policy", F.col("id").alias("turn_id"), F.lower("text").alias("left"))
    rows = asked.join(gold, "turn_id").join(left, ["policy", "turn_id"], "left").join(hits, ["qid", "turn_id"], "left").join(share, ["policy", "history_id"], "left")
    whole = lambda c: F.when(c, 1.0).otherwise(0.0)
    answer = F.when(F.contains("said", F.lower("answer")), whole(F.coalesce(F.contains("left", F.lower("answer")), F.lit(False))))
    return rows.select("policy", "dataset", "qtype", "cluster", F.col("asked").alias("qid"), F.coalesce("tokens_kept", F.lit(0.0)).alias("tokens_kept"), whole(F.col("left").isNotNull()).alias("evidence_kept"), F.coalesce("hit", F.lit(0.0)).alias("recall"), answer.alias("answer_kept"))


@registered(
    "SELECT policy, coalesce(qtype, 'all types') AS qtype, count(*)::BIGINT AS n, round(avg(tokens_kept), 4) AS tokens_kept, round(avg(evidence_kept), 4) AS evidence_kept, round(avg(recall), 4) AS recall, round(avg(answer_kept), 4) AS answer_kept, count(answer_kept)::BIGINT AS n_answers FROM studied GROUP BY GROUPING SETS ((policy, qtype), (policy))",
    **_STUDY,
)
def forgetting_study(spark, sf_dir):
    rows = study_rows(spark, sf_dir)
    means = [F.round(F.avg(c), 4).alias(c) for c in ("tokens_kept", "evidence_kept", "recall", "answer_kept")]
    out = rows.groupingSets([[F.col("policy"), F.col("qtype")], [F.col("policy")]], "policy", "qtype").agg(F.count("*").alias("n"), *means, F.count("answer_kept").alias("n_answers"))
    return out.withColumn("qtype", F.coalesce("qtype", F.lit(reports.ALL)))


@registered(
    f"SELECT policy, qtype, {_R4} FROM ({o.jackknife('lost', 'policy, qtype')})",
    lost="SELECT s.policy, s.cluster, unnest([s.qtype, 'all types']) AS qtype, s.recall - n.recall AS value FROM studied s JOIN studied n ON n.qid = s.qid AND n.policy = 'none'",
    **_STUDY,
)
def forgetting_differences(spark, sf_dir):
    """Recall under each policy less recall of the same questions with everything kept."""
    rows = study_rows(spark, sf_dir).select("policy", "qid", "qtype", "cluster", "recall")
    none = Window.partitionBy("qid")
    pairs = rows.withColumn("value", F.col("recall") - F.max(F.when(F.col("policy") == "none", F.col("recall"))).over(none))
    means = stats.cluster_means(pairs.withColumn("qtype", F.explode(F.array(F.col("qtype"), F.lit(reports.ALL)))), ["policy", "qtype"])
    return means.select("policy", "qtype", *[F.round(c, 4).alias(c) for c in ("mean", "lo", "hi")], "n", "clusters")


@registered(
    f"SELECT r.qid, k.k::INT AS k, count(*)::BIGINT AS n_turns, sum(r.line_tokens + CASE WHEN nth = 1 THEN header_tokens ELSE 0 END)::BIGINT AS tokens FROM (VALUES (1), (3)) AS k(k) JOIN (SELECT *, row_number() OVER (PARTITION BY qid, most, session_id ORDER BY seq) AS nth FROM wide_) r ON r.most = k.k GROUP BY 1, 2",
    wide_="SELECT DISTINCT r.qid, k.k AS most, p.id, p.session_id, p.seq, p.line_tokens, p.header_tokens FROM rank_store r, (VALUES (1), (3)) AS k(k), (VALUES (0), (-1), (1)) AS o(d) JOIN pos x ON x.history_id = r.history_id AND x.session_id = r.session_id AND x.position = r.position + o.d JOIN priced p ON p.history_id = x.history_id AND p.id = x.id WHERE r.rank <= k.k AND r.score > 0",
)
def topk_units(spark, sf_dir):
    """Contexts of the first units and their neighbours, whatever they cost."""
    turns, questions = both(spark, sf_dir)
    plan = strategies.store(turns, questions, strategies.Config(neighbours=1))
    ks = plan.select("*", F.explode(F.array(F.lit(1), F.lit(3))).alias("k")).where("unit_ord <= k").withColumn("strategy", F.col("k").cast("string")).drop("k")
    return packing.totals(packing.packed(ks, turns, [10**9])).select("qid", F.col("strategy").cast("int").alias("k"), "n_turns", F.col("tokens").cast("bigint").alias("tokens"))


@registered(
    f"""SELECT dataset, histories, round(tokens_mean)::BIGINT AS tokens_mean, tokens_min, tokens_max, turns, questions, named AS names_a_time, unseen AS no_visible_evidence, mean_position, newest AS in_newest_tenth, in_text, needs_date, elsewhere FROM
  (SELECT count(*)::BIGINT AS histories, avg(t) AS tokens_mean, min(t)::BIGINT AS tokens_min, max(t)::BIGINT AS tokens_max, sum(n)::BIGINT AS turns FROM (SELECT history_id, sum({o.tokens('text')}) AS t, count(*) AS n FROM turns GROUP BY 1)),
  (SELECT any_value(dataset) AS dataset, count(*)::BIGINT AS questions, round(avg(CASE WHEN w IS NOT NULL THEN 1.0 ELSE 0.0 END), 4) AS named FROM questions JOIN windows USING (qid)),
  (SELECT round(avg(CASE WHEN seen THEN 0.0 ELSE 1.0 END), 4) AS unseen FROM seen_),
  (SELECT round(avg(stood_), 4) AS mean_position, round(avg(CASE WHEN stood_ >= 0.9 THEN 1.0 ELSE 0.0 END), 4) AS newest FROM (SELECT position / (n_turns - 1) AS stood_ FROM (SELECT history_id AS h, turn_id FROM questions) q JOIN pos ON pos.history_id = q.h AND pos.id = q.turn_id WHERE n_turns > 1)),
  (SELECT round(avg(CASE WHEN location = 'in_text' THEN 1.0 ELSE 0.0 END), 4) AS in_text, round(avg(CASE WHEN location = 'needs_date' THEN 1.0 ELSE 0.0 END), 4) AS needs_date, round(avg(CASE WHEN location = 'elsewhere' THEN 1.0 ELSE 0.0 END), 4) AS elsewhere FROM where_)""",
    seen_="SELECT len(list_intersect(list_filter(qt, lambda w: NOT list_contains(names, w)), tt)) > 0 AS seen FROM (SELECT qid, history_id AS h, turn_id, " + o.terms("question") + " AS qt FROM questions) q JOIN (SELECT id, " + o.terms("text") + " AS tt FROM turns) t ON t.id = q.turn_id JOIN (SELECT history_id AS h, flatten(list(DISTINCT " + o.terms("speaker") + ")) AS names FROM turns GROUP BY 1) n ON n.h = q.h",
    located=_LOCATED,
    dates=f"SELECT {o.date_words()} AS dw",
    where_="SELECT CASE WHEN len(missing) = 0 THEN 'in_text' WHEN len(list_filter(missing, lambda w: NOT regexp_full_match(w, '[0-9]+') OR length(w) = 4)) > 0 AND len(list_filter(missing, lambda w: NOT (regexp_full_match(w, '[0-9]+') OR list_contains(dw, w) OR regexp_full_match(rtrim(w, 'thsndr'), '[0-9]+')))) = 0 THEN 'needs_date' ELSE 'elsewhere' END AS location FROM located, dates",
)
def diagnostics(spark, sf_dir):
    turns, questions = both(spark, sf_dir)
    return reports.diagnostics(turns, questions, questions.select("qid", "history_id", "turn_id"))
