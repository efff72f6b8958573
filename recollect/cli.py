"""A memory in a folder of Parquet tables: python -m recollect.cli FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.temporal import parse_timestamp
from recollect.operators import bm25, facts, store
from recollect.plans import memory, strategies
from recollect.sources.files import read_jsonl

TABLES = {
    "turns": "id string, session_id string, seq bigint, speaker string, text string, ts timestamp_ntz, forgotten_at timestamp_ntz",
    "sessions": "id string, started_at timestamp_ntz, next_seq bigint",
    "facts": "id bigint, subject string, attribute string, value string, valid_from timestamp_ntz, source_turn string",
}


#: Into how many buckets of sessions the turns of a new memory are dealt.
BUCKETS = 64


def bucket(n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("session_id"), F.lit(n)).cast("int")


class Memory:
    """The tables of a folder. A write makes new files and then names what is current, in one step for each table.

    Turns lie in buckets of sessions. What changes turns writes the buckets that it touches again, and no others:
    a policy or a purge of one session costs a bucket, whatever the memory holds.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, Path(folder)

    def parts(self, name: str) -> dict[int | None, str]:
        """The current folders of a table by bucket; one that is not in buckets has the bucket None."""
        current = self.folder / f"{name}.current"
        paths = current.read_text().split() if current.exists() else []
        return {int(p.rpartition("bucket=")[2]) if "bucket=" in p else None: p for p in paths}

    def read(self, name: str, buckets: set[int] | None = None) -> DataFrame:
        """The table, or those buckets of it."""
        paths = [p for k, p in self.parts(name).items() if buckets is None or k is None or k in buckets]
        if not paths:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*[str(self.folder / p) for p in paths])

    def _name(self, name: str, paths: list[str]) -> None:
        fresh = self.folder / f"{name}.{uuid.uuid4().hex}"
        fresh.write_text("\n".join(paths))
        fresh.replace(self.folder / f"{name}.current")

    def write(self, **frames: DataFrame) -> None:
        self.folder.mkdir(parents=True, exist_ok=True)
        made = {name: f"{name}-{uuid.uuid4().hex}" for name in frames}
        for name, df in frames.items():
            df.write.parquet(str(self.folder / made[name]))
        for name, version in made.items():
            self._name(name, [version])

    def touched(self, changed: DataFrame) -> set[int]:
        """The buckets of rows that change; at most BUCKETS numbers come to the driver."""
        return {r.bucket for r in changed.select(bucket().alias("bucket")).distinct().collect()}

    def write_turns(self, turns: DataFrame, touched: set[int]) -> None:
        """Writes the touched buckets of ``turns`` and names them current beside the others, in one step.

        A table that is not in buckets yet is written whole. A bucket without turns is named no more.
        """
        self.folder.mkdir(parents=True, exist_ok=True)
        before, version = self.parts("turns"), f"turns-{uuid.uuid4().hex}"
        whole = None in before
        if not (touched or whole):
            return
        dealt = turns.withColumn("bucket", bucket())
        mine = dealt if whole else dealt.where(F.col("bucket").isin(*touched))
        mine.repartition("bucket").write.partitionBy("bucket").parquet(str(self.folder / version))
        fresh = [f"{version}/{p.name}" for p in sorted((self.folder / version).glob("bucket=*"))]
        self._name("turns", ([] if whole else [p for k, p in before.items() if k not in touched]) + fresh)

    def history(self) -> DataFrame:
        starts = self.read("sessions").select(F.col("id").alias("session_id"), F.col("started_at").alias("session_ts"))
        return store.live(self.read("turns")).join(starts, "session_id").withColumn("history_id", F.lit(0))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="recollect", description=__doc__)
    p.add_argument("folder")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [sub.add_parser(name)] and [sub.choices[name].add_argument(*a) if isinstance(a, tuple) else sub.choices[name].add_argument(a) for a in args]
    add("ingest", "path")
    add("add", "session", "speaker", "text", "time")
    add("remember", "subject", "attribute", "value", "time")
    add("search", "query", "now")
    add("context", "query", "now")
    sub.choices["search"].add_argument("-k", type=int, default=10)
    sub.choices["context"].add_argument("--budget", type=int, default=2048)
    add("facts", "now")
    add("history", "subject", "attribute")
    add("forget", "policy", "now")
    add("purge")
    add("stats")
    a = p.parse_args(argv)
    if a.command not in ("ingest", "add", "remember") and not Path(a.folder).is_dir():
        print(f"no memory at {a.folder}", file=sys.stderr)
        return 1
    if a.command == "add" and not a.text.strip():
        print("a turn needs a text", file=sys.stderr)
        return 1
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    m, now = Memory(spark, a.folder), parse_timestamp(F.lit(getattr(a, "now", None) or getattr(a, "time", None)))
    if a.command in ("ingest", "add"):
        if a.command == "ingest":
            batch = read_jsonl(spark, a.path).select(F.struct("session_ts", "session_id", "seq").alias("input_ord"), F.lit(0).alias("session_ord"), "id", "session_id", "session_ts", "speaker", "text", "ts")
        else:
            number = m.read("sessions").where(F.col("id") == a.session).agg(F.coalesce(F.max("next_seq"), F.lit(0)).alias("n"))
            batch = number.select(F.lit(0).alias("input_ord"), F.lit(0).alias("session_ord"), F.concat(F.lit(a.session), F.lit(":"), F.col("n").cast("string")).alias("id"), F.lit(a.session).alias("session_id"), now.alias("session_ts"), F.lit(a.speaker).alias("speaker"), F.lit(a.text).alias("text"), now.alias("ts"))
        turns, sessions, counts = store.ingested(m.read("turns"), m.read("sessions"), batch)
        said = counts.first()
        m.write_turns(turns, m.touched(turns.join(m.read("turns").select("id"), "id", "left_anti")))
        m.write(sessions=sessions)
        print(f"{said.added} added, {said.already_stored} already stored, {said.empty} empty")
    elif a.command == "remember":
        known = m.read("facts")
        new = spark.range(1).select(F.lit(1 + (known.agg(F.max("id")).first()[0] or 0)).cast("bigint").alias("id"), F.lit(a.subject).alias("subject"), F.lit(a.attribute).alias("attribute"), F.lit(a.value).alias("value"), now.alias("valid_from"), F.lit(None).cast("string").alias("source_turn"))
        m.write(facts=facts.filed(known.unionByName(new)))
    elif a.command in ("search", "context"):
        asked = spark.range(1).select(F.lit("q").alias("qid"), F.lit(0).alias("history_id"), F.lit(a.query).alias("question"), now.alias("now"))
        if a.command == "search":
            seen = m.history().where(F.col("ts") <= now)
            for r in bm25.ranked(strategies.store_scores(seen, asked), "position", a.k).join(seen.select("id", "speaker", "text"), "id").orderBy("rank").collect():
                print(f"{r.ts:%Y-%m-%d %H:%M} {r.speaker}: {r.text}")
        else:
            for r in memory.contexts(m.history(), m.read("facts"), asked, now, a.budget).collect():
                print(r.body)
    elif a.command == "facts":
        for r in facts.as_of(m.read("facts"), now).select(*facts.KEY, facts.rendered().alias("line")).orderBy(*facts.KEY).collect():
            print(r.line)
    elif a.command == "history":
        for r in facts.history_of(m.read("facts"), a.subject, a.attribute).select("valid_from", "id", facts.rendered().alias("line")).orderBy("valid_from", "id").collect():
            print(r.line)
    elif a.command == "forget":
        drop, most = store.policy(a.policy, now)
        before = m.read("turns")
        if most is None:
            hit = store.live(before).where(F.coalesce(drop, F.lit(False)))
            print(hit.count(), "forgotten")
            touched = m.touched(hit)
            m.write_turns(store.forgotten(m.read("turns", touched), drop, now), touched)
        else:
            cut = store.compacted(before, most).where("changed")
            print(cut.count(), "cut")
            touched = m.touched(cut)
            m.write_turns(store.compacted(m.read("turns", touched), most).drop("changed"), touched)
    elif a.command == "purge":
        gone = m.read("turns").where("forgotten_at is not null")
        print(gone.count(), "purged")
        touched = m.touched(gone)
        if touched:
            kept, cleared = store.purged(m.read("turns", touched), m.read("facts"))
            m.write(facts=cleared.select("id", "subject", "attribute", "value", "valid_from", "source_turn"))
            m.write_turns(kept, touched)
    else:
        found = store.stats(m.read("turns"), m.read("sessions"), facts.chained(m.read("facts"))).first()
        for k, v in found.asDict().items():
            print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
