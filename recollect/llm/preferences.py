"""Preference formatting: one prompt, and a chosen and a rejected completion with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import read

#: How a turn is written.
HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"


def _render(turn: Column) -> Column:
    return F.concat(F.lit(HEAD), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(TAIL))


def formatted(pairs: DataFrame, turns: DataFrame, role: str = "assistant", conv_id: str = "conv_id") -> DataFrame:
    """(pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    ``pairs`` names a chosen and a rejected conversation. The longest run of first turns that
    both share, by role and text, is rendered once as the prompt; what follows on each side is
    its completion. Spans are the characters of a completion that a loss is taken on: the texts
    and end marks of the ``role``'s turns. Turns are ordered by turn, role and text; exact
    repeats of a turn count once. A conversation that is null or has no turns is empty: prompt
    and its completion are then empty. Equal conversations leave two empty completions. Repeated
    pair rows count once. Extra columns are ignored. A conversation's turns meet in one row, as
    its text does in the result, and the work follows their number; pairs are not formed here.
    """
    named = pairs.select("pair_id", "chosen_id", "rejected_id").distinct()
    sides = named.select("*", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv")))).alias("s"))
    own = turns.select(F.col(conv_id).alias("conv"), "turn", "role", "text").distinct()
    order = Window.partitionBy("conv").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.length(_render({"role": F.col("role"), "text": F.col("text")}))
    lead = F.length(F.coalesce("role", F.lit(""))) + len(HEAD + MIDDLE)
    own = own.select("conv", F.struct("turn", "role", "text", lead.alias("lead"), whole.alias("size"), F.sum(whole).over(order).cast("int").alias("stop")).alias("t"))
    met = sides.select("pair_id", "chosen_id", "rejected_id", F.col("s.side").alias("side"), F.col("s.conv").alias("conv")).join(own, "conv", "left")
    both = met.groupBy("pair_id", "chosen_id", "rejected_id").agg(*[F.sort_array(F.collect_set(F.when(F.col("side") == k, F.col("t")))).alias(name) for k, name in enumerate(("c", "r"))])
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]), F.lit(False)))
    size = F.least(F.size("c"), F.size("r"))
    first = F.array_position(same, False)
    both = both.withColumn("prompt_turns", F.when(first > 0, F.least(first.cast("int") - 1, size)).otherwise(size))
    rest = lambda x: F.slice(x, F.col("prompt_turns") + 1, F.size(x))
    both = both.withColumn("prompt", F.array_join(F.transform(F.slice("c", F.lit(1), F.col("prompt_turns")), _render), ""))
    both = both.withColumn("before", F.coalesce(F.get("c", F.col("prompt_turns") - 1)["stop"], F.lit(0)))
    for x in ("c", "r"):
        both = both.withColumn(x, rest(x))
    # Where a turn stops in its conversation is known; what went before is the prompt on both sides.
    mark = lambda t: F.struct((t["stop"] - t["size"] + t["lead"] - F.col("before")).alias("start"), (t["stop"] - F.col("before")).alias("stop"))
    spans = lambda x: F.transform(F.filter(x, lambda t: t["role"] == role), mark)
    text = lambda x: F.array_join(F.transform(x, _render), "")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt", text("c").alias("chosen"), text("r").alias("rejected"), spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans")
    )


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as chosen and rejected; a missing one leaves a null."""
    ids = turns.where("conv_id is not null").select("conv_id").distinct()
    pair = ids.groupBy(F.floor(F.col("conv_id") / 2).alias("pair_id"))
    return pair.agg(F.max(F.when(F.pmod("conv_id", F.lit(2)) == 0, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(F.pmod("conv_id", F.lit(2)) == 1, F.col("conv_id"))).alias("rejected_id"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of neighbouring conversations, as ``formatted`` renders it, with spans as text."""
    turns = read(spark, sf_dir, "conversations")
    found = formatted(neighbour_pairs(turns), turns)
    spans = lambda x: F.array_join(F.transform(x, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"))), ",")
    return found.select(
        "pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("bigint").alias("prompt_turns"), "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans")
    )
