"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import NOT_WORD, read, row_hashes, split_words, table_copy, whole_rows

#: Word offsets that a seed looks at; the positions between are ignored, so a replaced word
#: there changes nothing. Wherever two words of ten (one of eight or nine) are replaced, some
#: place of one of these masks in them meets neither: no such overlap is missed.
MASKS = ((0, 1, 2, 4, 6), (0, 1, 3, 8, 9), (0, 3, 4, 6, 7))
#: Items with fewer words are sought by a seed of all their words. From there up to SHORT words,
#: an item is sought by masks that leave out one of its words each.
MIN_WORDS, SHORT = 5, 7
#: Places of a text that one row of its words is for.
STEP = 64
#: Up to this many seeds of test items (some 64 MB in a hash table) are broadcast.
BROADCAST_SEEDS = 2_000_000
#: Up to this many ids of documents (some 32 MB) are broadcast.
BROADCAST_IDS = 1_000_000


def all_but_one(n: int) -> list[tuple[int, ...]]:
    """The masks of n words that leave out one of them, as offsets from the first word left."""
    left = [[k for k in range(n) if k != gone] for gone in range(n)]
    return sorted({tuple(k - m[0] for k in m) for m in left})


def _words(text: str) -> Column:
    return split_words(F.lower(F.col(text)), NOT_WORD)


def _spots(df: DataFrame, keys: list[str], words: Column, shapes: list[tuple[int, ...]]) -> DataFrame:
    """(*keys, at, k, seed, lasts): the hash of each shape at each place where it fits, and all shapes' hashes at the place before.

    Words are hashed once; a text is cut into runs of STEP places and what shapes reach beyond them, so that a row of
    a place has a run with it and not the text: a long text costs in proportion to its length.
    """
    ahead = max(m[-1] for m in shapes)
    hashes = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(words, lambda w: F.xxhash64(w)))
    # Bound as a variable, or the hashes would be made again for each run. A run begins with the word before it.
    cut = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(h) - 2) / STEP).cast("int"))), lambda c: F.slice(h, c * STEP + 1, F.lit(STEP + ahead + 1)))
    runs = df.select(*keys, F.posexplode(F.element_at(F.transform(F.array(hashes), cut), 1)).alias("run", "h"))
    places = runs.select(*keys, "run", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.least(F.lit(STEP), F.size("h") - 1) - 1))).alias("i"))
    word = lambda o: F.get("h", F.col("i") + o + 1)
    at = lambda by: F.array(*[F.when(word(m[-1]).isNotNull() & word(by).isNotNull(), F.xxhash64(F.lit(k), *[word(o + by) for o in m])) for k, m in enumerate(shapes)])
    hashed = places.select(*keys, (F.col("run") * STEP + F.col("i")).alias("at"), at(0).alias("seeds"), at(-1).alias("lasts"))
    return hashed.select(*keys, "at", "lasts", F.posexplode("seeds").alias("k", "seed")).where("seed is not null")


def overlaps(
    docs: DataFrame,
    items: DataFrame,
    keys: list[str],
    window: int = 10,
    share: float = 0.8,
    masks: tuple[tuple[int, ...], ...] = MASKS,
    broadcast_seeds: int = BROADCAST_SEEDS,
    text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """(*keys, item_id, item_words, first_word, matched_words) for each test item met in a document, as ``leaks`` says."""
    tests = items.select(F.col(item_id).cast("bigint").alias("item_id"), _words(text).alias("item")).where(F.size("item") > 0).distinct()
    short = [r[0] for r in tests.where(F.size("item") <= SHORT).select(F.size("item")).distinct().collect()]  # SHORT values at most
    parts = [*masks, *(m for n in sorted(short) if n >= MIN_WORDS for m in all_but_one(n))]
    # A shape of a whole item is for items of that length only, or each word of a longer one would be a seed.
    whole = [tuple(range(n)) for n in sorted(short) if n < MIN_WORDS]
    shapes = [*parts, *whole]
    fits = F.col("k") < len(parts)
    for k, m in enumerate(whole, len(parts)):
        fits = fits | ((F.col("k") == k) & (F.col("m") == len(m)))
    sought = _spots(tests.withColumn("m", F.size("item")), ["item_id", "m"], F.col("item"), shapes).where(fits)
    seeds = sought.select("item_id", "m", F.col("at").alias("item_at"), "seed", F.get("lasts", F.col("k")).alias("item_last")).distinct()
    plain = docs.select(*keys, F.col(text).alias("text"), F.xxhash64(F.lit(1), *keys, text).alias("row"), F.xxhash64(F.lit(2), *keys, text).alias("row_2"))
    spots = _spots(plain, ["row", "row_2"], _words("text"), shapes)
    # Where a mask agrees at the places before, too, it is the same diagonal, met there already.
    anew = F.coalesce(F.get("lasts", F.col("k")) != F.col("item_last"), F.lit(True))
    met = spots.join(F.broadcast(seeds) if seeds.count() <= broadcast_seeds else seeds, "seed").where(anew)
    met = table_copy(met.select("row", "row_2", "item_id", "m", (F.col("at") - F.col("item_at")).alias("start")).distinct(), "diagonals")
    few = met.count() <= BROADCAST_IDS
    held = F.broadcast(met) if few else met
    there = F.slice("words", F.greatest("start", F.lit(0)) + 1, F.greatest(F.col("m") + F.least("start", F.lit(0)), F.lit(0)))
    # Words are cut again for the documents that were met, and for those only.
    again = plain.join(F.broadcast(met.select("row", "row_2").distinct()) if few else met.select("row", "row_2").distinct(), ["row", "row_2"], "left_semi").select(*keys, "row", "row_2", _words("text").alias("words"))
    hits = again.join(held, ["row", "row_2"]).select(*keys, "item_id", "start", there.alias("there")).join(tests, "item_id")
    lead = F.greatest(-F.col("start"), F.lit(0))
    same = F.zip_with("item", F.concat(F.array_repeat(F.lit(""), lead), F.col("there")), lambda a, b: F.when(a == b, 1).otherwise(0))
    size = F.least(F.size("same"), F.lit(window))
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size("same") - size), lambda i: F.aggregate(F.slice("same", i + 1, size), F.lit(0), lambda s, x: s + x)))
    checked = (
        hits.select(*keys, "item_id", "start", F.size("item").alias("item_words"), same.alias("same"))
        .withColumn("total", F.aggregate("same", F.lit(0), lambda s, x: s + x))
        .where(F.col("total") >= F.ceil(size * share))
        .where(best >= F.ceil(size * share))
    )
    return checked.groupBy(*keys, "item_id").agg(
        F.max("item_words").cast("bigint").alias("item_words"),
        F.max_by(F.greatest("start", F.lit(0)), F.struct("total", -F.col("start"))).cast("bigint").alias("first_word"),
        F.max("total").cast("bigint").alias("matched_words"),
    )


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """(doc_id, item_id, item_words, first_word, matched_words) for each test item met in a document.

    A seed is a hash of the words at a mask's offsets. Where a seed of a document equals one of
    an item, the item is laid over the document on that diagonal, and reported if among some
    ``window`` consecutive words of it (all of a shorter one) at least ``share`` equal the
    document's: replaced words are tolerated, in the seed and in the overlap. With the masks,
    window and share given here, every diagonal that passes the overlap check has a seed, so the
    result is that of a comparison of all pairs. matched_words is the best such diagonal's equal
    words, first_word its place in the document.

    Words are lower-cased; null or empty texts have none, and long ones are read whole. A diagonal is
    checked once, however often its words repeat: a text of one word said again and again meets an item of
    that word on as many diagonals as both have words. Items under
    MIN_WORDS words are met where all their words stand. Rows with equal ids, null ones too, count
    as one document or item; of equal diagonals the first in the document counts. Extra columns
    are ignored; an empty table on either side gives no rows. Items' seeds are counted, and broadcast only up to
    ``broadcast_seeds``; beyond, they meet in a shuffle. So are the diagonals, up to BROADCAST_IDS.
    """
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(options.pop("text", "text")).alias("text"))
    return overlaps(named, items, ["doc_id"], **options)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents in which no test item was met, with all their columns.

    Each row is judged by its own text, whatever its id; rows are told apart by two hashes of their
    content. A null text stays. The hashes of leaks are written and counted; up to BROADCAST_IDS
    of them are broadcast, so that the texts stay where they are.
    """
    rows = whole_rows(docs, F.col(text).alias("text"), *row_hashes(docs, "own", "own_2"))
    found = table_copy(overlaps(rows.select("own", "own_2", "text"), items, ["own", "own_2"], **options).select("own", "own_2").distinct(), "leaks")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    return rows.join(found, ["own", "own_2"], "left_anti").select("doc.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` met in a document, as ``leaks`` finds them."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
