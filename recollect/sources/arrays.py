"""JSON arrays of objects, read by many tasks: a file is cut at closing braces, and its state is summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What may stand before the first object of an array, before a later one, and after the last.
FIRST, LATER, LAST = r"^\s*\[\s*$", r"^\s*,\s*$", r"^\s*(\[\s*)?\]\s*$"


def _depth(text: Column) -> Column:
    """Opening less closing braces and brackets."""
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return count(r"[{\[]") - count(r"[}\]]")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, n, piece, flips, plain, quoted): what stands between closing braces, in many tasks.

    flips: how many quotes it has, which open or close a string; an escaped one is not counted, and no
    escape is cut in two, as none has a brace. plain and quoted: what the piece adds to the depth if it
    begins outside or inside a string.
    """
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("piece"))
    parts = F.split(F.regexp_replace("piece", r"\\.", ""), '"')
    cut = raw.withColumn("parts", parts)
    side = lambda odd: F.array_join(F.filter("parts", lambda x, i: i % 2 == odd), "")
    return cut.select("file", "block", "n", "piece", (F.size("parts") - 1).alias("flips"), _depth(side(0)).alias("plain"), _depth(side(1)).alias("quoted"))


def _running(order, through: bool) -> Window:
    return order.rowsBetween(Window.unboundedPreceding, 0 if through else -1)


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, value): the text of each object of the arrays in the files, numbered from 0.

    The files are read in byte ranges that need not begin at an object. Each range sums up what it does
    to the depth of braces and brackets for both cases, that it begins inside a string or outside; a running
    sum over a file's ranges, one row each, tells which case holds and at what depth it begins. So only
    the pieces of one object meet in a task, wherever its ranges were read.

    A file that is no array of objects is an error that names it: another start or end, something other than a comma
    between two objects, an open string or brace. An empty array has no rows, and no file is an error of the reader.
    """
    within, over = Window.partitionBy("file", "block").orderBy("n"), Window.partitionBy("file").orderBy("block")
    p = _pieces(spark, path)
    # Whether a piece begins in a string, if its range does not; and what it then adds, its closing brace included.
    p = p.withColumn("odd", F.coalesce(F.sum("flips").over(_running(within, False)), F.lit(0)) % 2)
    close = lambda start: F.when((start + F.col("flips")) % 2 == 0, -1).otherwise(0)
    adds = lambda start: F.when(start % 2 == 0, F.col("plain")).otherwise(F.col("quoted")) + close(start)
    p = p.withColumn("add_0", adds(F.col("odd"))).withColumn("add_1", adds(F.col("odd") + 1))
    p = p.withColumn("up_0", F.sum("add_0").over(_running(within, True))).withColumn("up_1", F.sum("add_1").over(_running(within, True)))
    blocks = p.groupBy("file", "block").agg(F.sum("flips").alias("flips"), F.sum("add_0").alias("sum_0"), F.sum("add_1").alias("sum_1"), F.max("n").alias("last"))
    blocks = blocks.withColumn("inside", F.coalesce(F.sum("flips").over(_running(over, False)), F.lit(0)) % 2)
    own = F.when(F.col("inside") == 0, F.col("sum_0")).otherwise(F.col("sum_1"))
    blocks = blocks.withColumn("base", F.coalesce(F.sum(own).over(_running(over, False)), F.lit(0))).withColumn("end", F.max("block").over(Window.partitionBy("file")))
    p = p.join(blocks.select("file", F.col("block").alias("b"), "inside", "base", "last", "end").withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    p = p.withColumn("final", (F.col("block") == F.col("end")) & (F.col("n") == F.col("last")))
    after = F.col("base") + F.when(F.col("inside") == 0, F.col("up_0")).otherwise(F.col("up_1"))
    open_ = (F.col("inside") + F.col("odd") + F.col("flips")) % 2 == 1
    # The last piece of a file has no brace after it.
    p = p.withColumn("depth", after + F.when(F.col("final") & ~open_, 1).otherwise(0)).withColumn("open", open_)
    p = p.withColumn("ends", (F.col("depth") == 1) & ~F.col("open") & ~F.col("final"))
    ended = p.groupBy("file", "block").agg(F.count_if("ends").alias("many")).withColumn("before", F.coalesce(F.sum("many").over(_running(over, False)), F.lit(0)))
    p = p.join(ended.select(F.col("file").alias("f"), F.col("block").alias("b"), "before"), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))).drop("f", "b")
    p = p.withColumn("number", F.col("before") + F.coalesce(F.sum(F.col("ends").cast("bigint")).over(_running(within, False)), F.lit(0)))
    objects = p.groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("block", "n", "piece"))).alias("pieces"), F.bool_or("final").alias("final"), F.max(F.when(F.col("final"), F.struct("depth", "open"))).alias("state"))
    text = F.array_join(F.transform("pieces", lambda x: x["piece"]), "}")
    objects = objects.withColumn("text", text).withColumn("start", F.instr("text", "{"))
    head = F.when(F.col("start") > 0, F.substring("text", F.lit(1), F.col("start") - 1))
    good = F.when(F.col("final"), F.col("text").rlike(LAST) & (F.col("state.depth") == 0) & ~F.col("state.open") & (F.col("text").contains("[") == (F.col("number") == 0)))
    good = good.otherwise(F.coalesce(F.when(F.col("number") == 0, head.rlike(FIRST)).otherwise(head.rlike(LATER)), F.lit(False)))
    told = F.concat(F.col("file"), F.lit(": not an array of JSON objects, at object "), F.col("number").cast("string"))
    # Null for a good end: a condition on what is parsed may be tried on it before the row is left out.
    value = F.when(good & F.col("final"), F.lit(None).cast("string")).when(good, F.concat(F.substring("text", F.col("start"), F.length("text")), F.lit("}"))).otherwise(F.raise_error(told).cast("string"))
    # A file's end is read too, so that a cut one is an error even where all its objects are whole.
    return objects.where(~F.col("final") | ~good).select("file", "number", value.alias("value"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of the arrays in the files as rows of a schema; an object that is no JSON, or does not fit, is an error."""
    found = array_objects(spark, path).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("o"))
    return found.select("o.*")
