"""Mixing sources to target weights, block by block, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import read, table_copy

#: Words of a block; words of a bucket, in which documents are packed one after another.
BLOCK, BUCKET = 64, 1 << 20
#: Rows of a bucket: texts without words would else all stand in one.
BUCKET_ROWS = 1 << 16
#: Slots of an output shard at most, and the output shards of a mix at least: a small mix has smaller shards.
SHARD, SHARDS = 512, 64
#: Slots, or copies of a row, that one row stands for until it is written out.
RUN = 16384
#: Cells of the line on which a slot's draw is looked up, and the sources up to which that table is broadcast.
CELLS, BROADCAST_SOURCES = 4096, 500_000
#: Shards whose counts one window adds up.
SPAN = 4096
#: Rounds of the permutation, and the prime its bits are drawn with (fixed: the SQL uses it too).
ROUNDS, PRIME = 12, 2147483647
SEED = 20011


def permuted(df: DataFrame, out: str, value: Column, size: Column, seed: Column, rounds: int = ROUNDS) -> DataFrame:
    """The rows with a column that permutes 0..size-1: a swap-or-not shuffle keyed by the seed.

    Each round pairs x with (K - x) mod size and swaps the two if a bit of the larger one's hash
    says so. Any size below 2**61 works, without a table of the permutation and without retries.
    """
    df = df.withColumn(out, value.cast("bigint")).withColumn("_n", size.cast("bigint")).withColumn("_s", seed.cast("bigint"))
    for r in range(rounds):
        a, b = 1103515245 + 7919 * r, 12345 + 104729 * r
        high = F.pmod(F.pmod(F.col("_s") * (2 * r + 1) + b, F.lit(PRIME)) * a, F.lit(PRIME))
        low = F.pmod(high * a + b, F.lit(PRIME)) % (1 << 30)
        df = df.withColumn("_p", F.pmod((high * (1 << 30) + low) % F.col("_n") - F.col(out), F.col("_n")))
        larger = F.greatest(out, "_p")
        df = df.withColumn("_z", F.pmod(larger % PRIME + F.floor(larger / PRIME) * 7 + F.col("_s") + b, F.lit(PRIME)))
        bit = F.pmod(F.pmod(F.col("_z") * F.col("_z"), F.lit(PRIME)) * a + b, F.lit(PRIME)) < PRIME // 2
        df = df.withColumn(out, F.when(bit, F.col("_p")).otherwise(F.col(out)))
    return df.drop("_n", "_s", "_p", "_z")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_rank, source_size, target) from one row (source, source_size) for each source.

    Sources take the weights in turn, by code point with null last, and share the sum of all
    sizes; a share over ``most`` times the source's size stops there, and the rest is shared
    again by weight. The level at which that ends is found in one pass over the sources in
    order of cap to weight. Windows over all sources have one row for each source.
    """
    ranked = sizes.withColumn("source_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weighed = ranked.withColumn("w", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("source_rank"), F.lit(len(weights)))).cast("bigint"))
    weighed = weighed.withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("w"), "source_rank").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(0))
    rest = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    share = F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levelled = weighed.withColumn("level", rest.cast("double") / share)
    level = F.max("level").over(all_rows)
    return levelled.select("source", "source_rank", "source_size", F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"))


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """The rows, dealt into as many partitions as a shuffle has.

    The number is asked for, as adaptive execution would merge few short rows into one task, which
    would then write out all that they stand for.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def written_out(rows: DataFrame, count: str, number: str) -> DataFrame:
    """Each row ``count`` times, numbered from 0 in the column ``number``, without the count.

    Rows that stand for more than RUN others become rows of runs first and are dealt anew, so that
    no task writes out all that one row stands for.
    """
    runs = rows.where(F.col(count) > RUN).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1, F.lit(RUN).cast("bigint"))).alias("run"))
    runs = spread(runs, *rows.columns, "run")
    few = rows.where(F.col(count).between(1, RUN)).withColumn("run", F.lit(0).cast("bigint"))
    every = F.explode(F.sequence("run", F.least(F.col("run") + RUN, count) - 1)).alias(number)
    return runs.select("*", every).union(few.select("*", every)).drop("run", count)


def packed(docs: DataFrame, block: int = BLOCK, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """Documents with the place of their words, and sources with their blocks.

    Documents (doc_id, source, size) of a source are dealt into buckets of about ``bucket``
    words, or BUCKET_ROWS rows, by a hash of id, size and, for rows equal in these, a number; they are packed there one
    after another into blocks of ``block`` words. So no window holds a whole source, or all rows
    that have no id. first_block is the number of the bucket's first block.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    same = docs.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
    wide = written_out(same, "rows", "copy").join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    many = F.ceil(F.greatest(F.greatest("source_size", F.lit(1)) / bucket, F.col("source_rows") / BUCKET_ROWS)).cast("bigint")
    drawn = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(PRIME)) * 7919 + F.col("size") % PRIME * 104729 + F.col("copy") % PRIME * 31
    dealt = wide.withColumn("bucket", F.pmod(drawn % PRIME, many))
    order = Window.partitionBy("source", "bucket").orderBy("doc_id", "size", "copy")
    placed = dealt.withColumn("row", F.row_number().over(order)).withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    counted = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block).cast("bigint"))
    ahead = Window.partitionBy("source").orderBy("bucket")
    filled = counted.withColumn("first_block", F.sum("blocks").over(ahead.rowsBetween(Window.unboundedPreceding, 0)) - F.col("blocks"))
    return placed, filled


def plan(filled: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_rank, source_size, target, blocks, cap, slots, low, all_slots) by source.

    slots is how many blocks make up the target; a source never gets more than cap, ``most`` passes over its
    blocks. low is the sum of slots of the sources before.
    """
    sizes = filled.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("blocks").alias("blocks"))
    with_target = targets(sizes.select("source", "source_size"), weights, most)
    both = with_target.join(sizes.select(F.col("source").alias("s"), "blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    slots = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("bigint")
    both = both.withColumn("cap", F.col("blocks") * most).withColumn("slots", F.least(slots, "cap"))
    before = Window.orderBy("source_rank").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("low", F.coalesce(F.sum("slots").over(before), F.lit(0))).withColumn("all_slots", F.sum("slots").over(Window.partitionBy(F.lit(0))))


def mixed(df: DataFrame, out: str, start: Column, rounds: tuple[tuple[int, int], ...] = ((1103515245, 12345), (747796405, 104729), (1566083941, 7919))) -> DataFrame:
    """The rows with a draw of 61 bits: rounds of a quadratic map modulo PRIME, of which the last two are joined."""
    df = df.withColumn("_v", F.pmod(start, F.lit(PRIME)))
    for a, b in rounds:
        df = df.withColumn("_u", F.col("_v")).withColumn("_v", F.pmod(F.pmod(F.col("_v") * F.col("_v"), F.lit(PRIME)) + F.col("_v") * a + b, F.lit(PRIME)))
    return df.withColumn(out, F.col("_u") * (1 << 30) + F.col("_v") % (1 << 30)).drop("_u", "_v")


def shard_size(all_slots: Column, shard: int, shards: int) -> Column:
    """Slots of a shard: ``shard``, or less so that there are ``shards`` of them, and the last is about as large."""
    most = F.greatest(F.lit(1), F.least(F.lit(shard), F.ceil(all_slots / shards)))
    return F.ceil(all_slots / F.ceil(all_slots / most)).cast("bigint")


def seed_start(seed: int) -> int:
    """Where a seed's draws begin, far from those of the next seed."""
    return seed * 1103515245 % PRIME


def draws(planned: DataFrame, shard: int = SHARD, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(source_rank, shard, drawn): each output shard's draw over the sources, where it is not 0.

    Every slot of a shard draws a source with the chances of the targets: a number below the sum of all
    slots, looked up among the sources' stretches of that line. So a shard's counts are multinomial.
    The line is cut into CELLS equal cells; a slot meets the sources that reach into its cell.
    """
    total = planned.agg(F.max("all_slots").alias("all_slots")).where("all_slots > 0").withColumn("many", F.col("all_slots"))
    every = written_out(total, "many", "i")
    every = mixed(every, "u", F.col("i") % PRIME + F.floor(F.col("i") / PRIME) * 7 + seed_start(seed))
    wide = F.ceil(F.col("all_slots") / CELLS).cast("bigint")
    thrown = every.select(F.floor(F.col("i") / shard_size(F.col("all_slots"), shard, shards)).cast("bigint").alias("shard"), F.pmod("u", F.col("all_slots")).alias("u"), wide.alias("wide")).withColumn("cell", F.floor(F.col("u") / F.col("wide")))
    line = planned.where("slots > 0").select("source_rank", "low", (F.col("low") + F.col("slots")).alias("high"), wide.alias("w"))
    line = line.select("source_rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / F.col("w")), F.floor((F.col("high") - 1) / F.col("w")))).alias("cell"))
    line = F.broadcast(line) if planned.count() <= BROADCAST_SOURCES else line
    met = thrown.join(line, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return met.groupBy("source_rank", "shard").agg(F.count("*").alias("drawn"))


def shard_counts(planned: DataFrame, drawn: DataFrame, shard: int = SHARD, shards: int = SHARDS) -> DataFrame:
    """(source, source_rank, blocks, shard, slots, first): the slots of each source in each output shard.

    A shard's count is its own draw, less what the shards before it drew too much, or more what they drew too
    little: up to a shard, a source has what the targets give the shards before, and the shard's own draw on top.
    Where that would take slots back, the source has none in the shard; what it is owed waits for its next draw, or the last shard.
    So a source's total is off its target by the last shard's draw alone, which deviates by sqrt(n p) for n slots and
    a share p, and is never above its cap. first numbers a source's slots over the shards.
    """
    n = shard_size(F.col("all_slots"), shard, shards)
    own = planned.where("slots > 0").select("source", "source_rank", "blocks", "cap", "slots", "all_slots")
    line = F.floor(F.col("slots").cast("double") * (F.col("shard") * n).cast("double") / F.col("all_slots").cast("double") + 0.5).cast("bigint")
    reached = drawn.join(own.withColumnRenamed("source_rank", "r"), F.col("source_rank") == F.col("r")).select("source_rank", "shard", (line + F.col("drawn")).alias("up"))
    last = own.withColumn("shard", F.ceil(F.col("all_slots") / n).cast("bigint") - 1).select("source_rank", "shard", line.alias("up"))
    up = reached.union(last).groupBy("source_rank", "shard").agg(F.max("up").alias("up")).withColumn("span", F.floor(F.col("shard") / SPAN))
    # The highest so far, in two steps: over spans of shards, and within a span.
    spans = up.groupBy("source_rank", "span").agg(F.max("up").alias("top"))
    spans = spans.withColumn("base", F.coalesce(F.max("top").over(Window.partitionBy("source_rank").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    up = up.join(spans.select(F.col("source_rank").alias("r"), F.col("span").alias("sp"), "base"), (F.col("source_rank") == F.col("r")) & (F.col("span") == F.col("sp"))).drop("r", "sp")
    within = Window.partitionBy("source_rank", "span").orderBy("shard")
    before = F.greatest("base", F.coalesce(F.max("up").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    up = up.withColumn("before", before).withColumn("now", F.greatest("up", "before"))
    whole = up.join(own.withColumnRenamed("source_rank", "r"), F.col("source_rank") == F.col("r"))
    first, end = F.least("before", "cap"), F.least("now", "cap")
    return whole.select("source", "source_rank", "blocks", "shard", (end - first).alias("slots"), first.alias("first")).where("slots > 0")


def drawn_slots(counts: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, shard, block) for every slot of the mix.

    The slots of a shard's source are the next of that source's: its k-th reads the block with the
    index perm(k mod blocks), by a permutation of its own for each pass k div blocks.
    """
    slots = written_out(spread(counts, "source_rank", "shard"), "slots", "n").withColumn("k", F.col("first") + F.col("n"))
    turn = F.floor(F.col("k") / F.col("blocks"))
    slots = permuted(slots, "block", F.col("k") % F.col("blocks"), F.col("blocks"), F.pmod(F.lit(seed) + F.col("source_rank") * 31 + turn * 17, F.lit(PRIME)))
    # Written once: a condition on these columns, pushed down through the rounds, would double in each.
    return table_copy(slots.select("source", "shard", "block"), "slots")


def mixture(
    docs: DataFrame,
    block: int = BLOCK,
    bucket: int = BUCKET,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    shard: int = SHARD,
    shards: int = SHARDS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of the documents.

    taken counts the words of the document in the mix, repeats included: at most ``most`` times
    its size. The mix holds the blocks that its output shards drew, so a source's words are near its target
    (see ``shard_counts``). A null text has size 0 and gives nothing; a null source is a source of its own.
    Rows with equal ids, or equal in all, are documents of their own; those equal in id, source and
    size share what they took in no stated order. A long text spans many blocks and is counted
    whole. Extra columns are ignored; no rows give no rows. Reruns agree: every draw is a function
    of the data and fixed seeds.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source).alias("source"), size.alias("size"))
    sized = table_copy(sized, "sizes")
    placed, filled = packed(sized, block, bucket)
    planned = table_copy(plan(filled, weights, most), "plan")
    slots = drawn_slots(table_copy(shard_counts(planned, draws(planned, shard, shards, seed), shard, shards), "shards"), seed)
    uses = slots.groupBy(F.col("source").alias("s"), "block").agg(F.count("*").alias("uses"))
    first = filled.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "first_block")
    at = placed.join(first, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    parts = at.select("doc_id", "source", "bucket", "row", "size", "start", "first_block", F.explode_outer(reach).alias("own"))
    parts = parts.withColumn("words", F.least((F.col("own") + 1) * block, F.col("start") + F.col("size")) - F.greatest(F.col("own") * block, "start"))
    parts = parts.withColumn("number", F.col("first_block") + F.col("own")).drop("start", "first_block", "own")
    met = parts.join(uses, F.col("source").eqNullSafe(F.col("s")) & (F.col("number") == F.col("block")), "left").drop("s")
    taken = met.groupBy("source", "bucket", "row", "doc_id", "size").agg(F.sum(F.coalesce(F.col("words") * F.col("uses"), F.lit(0))).cast("bigint").alias("taken"))
    shares = planned.select(F.col("source").alias("s"), "source_size", F.round("target", 6).alias("target"))
    return taken.join(shares, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "source_size", "target", "taken")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, as ``mixture`` draws it."""
    return mixture(read(spark, sf_dir, "documents"))
