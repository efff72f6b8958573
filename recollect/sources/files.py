"""Readers of conversation files: JSON lines of turns, dialogues with questions, haystacks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions.parsing import evidence_ids
from recollect.functions.temporal import parse_timestamp, parsed
from recollect.sources.arrays import read_array

FIELDS = ("session", "time", "speaker", "text")
#: Question types by number, and by name (fixed values).
DIALOGUE_TYPES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "abstention"}
HAYSTACK_TYPES = {
    "single-session-user": "single-hop",
    "single-session-assistant": "single-hop-assistant",
    "single-session-preference": "preference",
    "multi-session": "multi-hop",
    "temporal-reasoning": "temporal",
    "knowledge-update": "knowledge-update",
}


@dataclass(frozen=True)
class Corpus:
    questions: DataFrame
    turns: DataFrame
    evidence: DataFrame  # qid, history_id, turn_id
    sessions: DataFrame  # qid, session_id: gold sessions


def _map(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): every line of the files with its number from 1, blank ones too, in many tasks.

    A file is read in byte ranges. How many lines each has is counted first, one row for each range,
    and summed up along the file; a line's number is that of its range and its place there.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    counts = raw.groupBy("file", "block").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("file").alias("f"), F.col("block").alias("b"), "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("ahead"))
    # A row for each range of a file: some millions at 100 TB, and then the join is shuffled.
    placed = raw.join(counts, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    return placed.select("file", (F.col("ahead") + F.col("n") - F.col("first") + 1).alias("line"), "value")


def jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, problem, session_id, ts, speaker, text) for each line that is not blank.

    problem is null for a line with session (string or whole number), time (ISO 8601), speaker
    and text (strings). line is its number in the file, from 1.
    """
    raw = numbered_lines(spark, path)
    v = F.try_parse_json("value")
    rows = raw.where(F.trim("value") != "").withColumn("v", v)
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    problem = F.when(F.col("v").isNull(), "not a JSON object").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "not a JSON object")
    for k in FIELDS:
        problem = problem.when(kind(k).isNull(), f"missing '{k}'")
    problem = problem.when(~kind("session").isin("STRING", "BIGINT"), "'session' must be a string or a whole number")
    for k in ("time", "speaker", "text"):
        problem = problem.when(kind(k) != "STRING", f"'{k}' must be a string")
    return rows.select("file", "line", problem.when(parsed(text("time")).isNull(), "'time' must be ISO 8601").alias("problem"), text("session").alias("session_id"), parsed(text("time")).alias("ts"), text("speaker").alias("speaker"), text("text").alias("text"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Turns (id, session_id, session_ts, speaker, text, ts, seq) of a file; a bad line is an error that names file and line.

    The id is a hash of what was said, when and by whom, with a counter for exact repeats, so a
    file can be read again and continued by another. A session starts at its earliest turn.
    """
    lines = jsonl_lines(spark, path)
    told = F.concat(F.lit("bad line: "), "file", F.lit(":"), F.col("line").cast("string"), F.lit(": "), "problem")
    rows = lines.withColumn("session_id", F.when(F.col("problem").isNotNull(), F.raise_error(told)).otherwise(F.col("session_id")))
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("ts", "SSSSSS")
    iso = F.when(micros == "000000", second).otherwise(F.concat(second, F.lit("."), micros))
    rows = rows.withColumn("key", F.concat_ws("|", iso, "speaker", "text"))
    repeat = F.row_number().over(Window.partitionBy("session_id", "key").orderBy("file", "line"))
    digest = F.substr(F.sha1(F.concat_ws("|", "key", repeat.cast("string"))), F.lit(1), F.lit(12))
    order = Window.partitionBy("session_id").orderBy("file", "line")
    return rows.select(F.concat_ws(":", "session_id", digest).alias("id"), "session_id", F.min("ts").over(Window.partitionBy("session_id")).alias("session_ts"), "speaker", "text", "ts", (F.row_number().over(order) - 1).alias("seq"))


_TURN = "array<struct<speaker:string,dia_id:string,text:string,blip_caption:string>>"
_DIALOGUE = "sample_id string, conversation map<string,string>, qa array<struct<question:string,answer:string,adversarial_answer:string,evidence:array<string>,category:int>>"


def _dialogue_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = read_array(spark, path, _DIALOGUE)
    numbers = F.sequence(F.lit(1), F.size(F.map_keys("conversation")) + 1)
    present = lambda n: F.map_contains_key("conversation", F.concat(F.lit("session_"), n.cast("string")))
    last = F.element_at(F.filter(numbers, lambda n: ~present(n)), 1) - 1
    return raw.withColumn("n_sessions", last)


def _dialogue_turns(raw: DataFrame) -> DataFrame:
    n = raw.where("n_sessions > 0").select("sample_id", "conversation", F.explode(F.sequence(F.lit(1), F.col("n_sessions"))).alias("n"))
    at = lambda k: F.try_element_at("conversation", F.concat(F.lit("session_"), F.col("n").cast("string"), F.lit(k)))
    said = n.select("sample_id", "n", parse_timestamp(at("_date_time")).alias("ts"), F.posexplode(F.from_json(at(""), _TURN)).alias("seq", "t"))
    photo = F.when(F.coalesce("t.blip_caption", F.lit("")) != "", F.concat(F.lit(" [shares a photo: "), "t.blip_caption", F.lit("]"))).otherwise("")
    return said.select(
        F.col("sample_id").alias("history_id"),
        F.concat_ws(":", "sample_id", "t.dia_id").alias("id"),
        F.concat("sample_id", F.lit(":S"), F.col("n").cast("string")).alias("session_id"),
        F.col("ts").alias("session_ts"),
        F.col("t.speaker").alias("speaker"),
        F.concat("t.text", photo).alias("text"),
        "ts",
        "seq",
    )


def read_dialogues(spark: SparkSession, path: str) -> Corpus:
    """Long dialogues, each with its questions, from an array of JSON objects.

    Sessions are numbered keys, read up to the first gap. Evidence ids are repaired where that
    is possible, and those that name no turn are dropped. Questions of category 5 have no answer
    in the dialogue; their answer says so. ``now`` is the time of the last session.
    """
    raw = _dialogue_rows(spark, path)
    turns = _dialogue_turns(raw)
    asked = raw.select("sample_id", F.posexplode("qa").alias("i", "q"))
    qid = F.concat("sample_id", F.lit(":q"), F.col("i").cast("string"))
    trap = F.concat(F.lit("Not answerable: nothing of the kind is said about them (a trap answer is: "), "q.adversarial_answer", F.lit(")"))
    last = turns.groupBy("history_id").agg(F.max("session_ts").alias("now"))
    questions = asked.join(last, asked["sample_id"] == last["history_id"]).select(
        qid.alias("qid"), F.lit("locomo").alias("dataset"), "history_id", _map(DIALOGUE_TYPES, F.col("q.category")).alias("qtype"), F.col("q.category").cast("string").alias("raw_type"), F.col("q.question").alias("question"), F.when(F.col("q.category") == 5, trap).otherwise(F.col("q.answer")).alias("answer"), "now"
    )
    ids = F.flatten(F.transform(F.coalesce("q.evidence", F.array().cast("array<string>")), evidence_ids))
    named = asked.select(qid.alias("qid"), F.col("sample_id").alias("history_id"), F.explode(F.array_distinct(ids)).alias("e")).select("qid", "history_id", F.concat_ws(":", "history_id", "e").alias("turn_id"))
    evidence = named.join(turns.select("history_id", F.col("id").alias("turn_id")), ["history_id", "turn_id"], "left_semi").select("qid", "history_id", "turn_id")
    cut = F.regexp_replace(F.regexp_replace("turn_id", r":[^:]*$", ""), ":D", ":S")
    return Corpus(questions, turns, evidence, evidence.select("qid", cut.alias("session_id")).distinct())


def evidence_audit(spark: SparkSession, path: str) -> DataFrame:
    """One row: how many evidence strings name a turn as written, after repair, or not at all."""
    raw = _dialogue_rows(spark, path)
    known = F.flatten(F.transform(F.filter(F.map_keys("conversation"), lambda k: k.rlike("^session_[0-9]+$")), lambda k: F.coalesce(F.from_json(F.try_element_at("conversation", k), _TURN), F.array().cast(_TURN))))
    items = raw.select(F.transform(known, lambda t: t["dia_id"]).alias("known"), F.explode(F.flatten(F.transform("qa", lambda q: F.coalesce(q["evidence"], F.array().cast("array<string>"))))).alias("item"))
    ids = evidence_ids(F.col("item"))
    exact = F.array_contains("known", F.col("item"))
    repaired = ~exact & (F.size(ids) > 0) & (F.size(F.array_except(ids, "known")) == 0)
    return items.agg(F.count("*").alias("evidence_strings"), F.count_if(exact).alias("exact"), F.count_if(repaired).alias("repaired"), F.count_if(~exact & ~repaired).alias("unresolvable"))


_HAYSTACK = (
    "question_id string, question_type string, question string, answer string, question_date string, haystack_session_ids array<string>, haystack_dates array<string>, "
    "haystack_sessions array<array<struct<role:string,content:string,has_answer:boolean>>>, answer_session_ids array<string>"
)


def read_haystacks(spark: SparkSession, path: str) -> Corpus:
    """Questions with a history of sessions each, from an array of JSON objects.

    A session that occurs twice counts once, with a flag; two that differ under one id are an
    error, and so are lists of different lengths. Flags also tell of sessions after the question
    and of gold sessions without a gold turn. Ids ending in _abs are unanswerable questions.
    """
    raw = read_array(spark, path, _HAYSTACK)
    sizes = (F.size("haystack_session_ids") == F.size("haystack_dates")) & (F.size("haystack_dates") == F.size("haystack_sessions"))
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("sid"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    checked = F.when(sizes, zipped).otherwise(F.raise_error(F.concat("question_id", F.lit(": lists of sessions differ in length"))).cast("array<struct<sid:string,date:string,turns:array<struct<role:string,content:string,has_answer:boolean>>>>"))
    every = raw.select("question_id", parse_timestamp(F.col("question_date")).alias("now"), F.posexplode(checked).alias("n", "s"))
    one = every.groupBy("question_id", "s.sid").agg(F.first("now").alias("now"), F.min_by("s", "n").alias("s"), F.count("*").alias("copies"), F.count_distinct(F.to_json("s.turns")).alias("kinds"))
    bad = F.raise_error(F.concat("question_id", F.lit(": session "), "sid", F.lit(" appears twice with different turns"))).cast("string")
    one = one.withColumn("sid", F.when(F.col("kinds") > 1, bad).otherwise(F.col("sid"))).withColumn("ts", parse_timestamp(F.col("s.date")))
    spoken = one.select("question_id", "sid", "ts", F.posexplode("s.turns").alias("seq", "t"))
    turn_id = F.concat_ws(":", "question_id", "sid", F.col("seq").cast("string"))
    marked = F.coalesce("t.has_answer", F.lit(False))
    turns = spoken.select(F.col("question_id").alias("history_id"), turn_id.alias("id"), F.col("sid").alias("session_id"), F.col("ts").alias("session_ts"), F.col("t.role").alias("speaker"), F.col("t.content").alias("text"), "ts", "seq")
    evidence = spoken.where(marked).select(F.col("question_id").alias("qid"), F.col("question_id").alias("history_id"), turn_id.alias("turn_id"))
    shown = spoken.where(marked).groupBy("question_id").agg(F.collect_set("sid").alias("shown"))
    seen = one.groupBy("question_id").agg(F.bool_or(F.col("copies") > 1).alias("twice"), F.bool_or(F.col("ts") > F.col("now")).alias("late"))
    gone = F.col("question_id").endswith("_abs")
    flags = F.array_compact(F.array(F.when(F.col("twice"), F.lit("duplicate_sessions")), F.when(F.col("late"), F.lit("future_sessions")), F.when(F.size(F.array_except("answer_session_ids", F.coalesce("shown", F.array().cast("array<string>")))) > 0, F.lit("partial_key"))))
    questions = raw.join(seen, "question_id", "left").join(shown, "question_id", "left").select(
        F.col("question_id").alias("qid"),
        F.lit("longmemeval").alias("dataset"),
        F.col("question_id").alias("history_id"),
        F.when(gone, "abstention").otherwise(_map(HAYSTACK_TYPES, F.col("question_type"))).alias("qtype"),
        F.concat("question_type", F.when(gone, "_abs").otherwise("")).alias("raw_type"),
        "question",
        "answer",
        parse_timestamp(F.col("question_date")).alias("now"),
        flags.alias("flags"),
    )
    return Corpus(questions, turns, evidence, raw.select(F.col("question_id").alias("qid"), F.explode(F.array_distinct("answer_session_ids")).alias("session_id")))
