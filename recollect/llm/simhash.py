"""SimHash near-duplicates: fingerprints joined with themselves by a walk over a binary trie."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import SPACE, Forest, components, lower_ascii, read, split_words, table_copy

#: Shingles whose bits are summed at once, and node pairs that are expanded at once.
CHUNK_SHINGLES, CHUNK_PAIRS = 1 << 16, 1 << 18
#: Fingerprints of a block; a task joins two blocks. Levels of the trie that are walked as a
#: join at least: a fingerprint then meets 1 + 4 + 6 cells, whatever the input's size.
BLOCK, LEVELS = 1 << 17, 4
#: Pairs of nodes with at most this many pairs of leaves below are compared leaf by leaf.
LEAVES = 16


def shingle_hashes(words, width: int):
    """XXH64 (seed 42) of each run of ``width`` words, or of the whole of a shorter sequence."""
    n = F.size(words)
    run = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(words, i + k) for k in range(width)])))
    whole = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.concat_ws(" ", words))))
    return F.when(n >= width, run).otherwise(whole)


def majority(hashes: pd.Series) -> pd.Series:
    """The word whose bits are set in over half of each array's hashes; 0 for an empty array."""
    out = np.zeros(len(hashes), np.int64)
    for k, h in enumerate(hashes):
        h = np.ascontiguousarray(h, dtype="<i8")
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK_SHINGLES):
            ones += np.unpackbits(h[at : at + CHUNK_SHINGLES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]
    return pd.Series(out)


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text", out: str = "fp") -> DataFrame:
    """The documents with a 64-bit SimHash column. Null, empty or blank text: 0."""
    with_words = docs.withColumn("_words", split_words(lower_ascii(F.col(text)), SPACE))
    return with_words.withColumn(out, F.pandas_udf(majority, "bigint")(shingle_hashes(F.col("_words"), width))).drop("_words")


def trie_pairs(left: np.ndarray, right: np.ndarray, budget: int, within: bool, bits: int = 64):
    """Index pairs of two sorted uint64 arrays that differ in at most ``budget`` bits, in parts.

    Only the first ``bits`` bits may be set; values may repeat.

    A sorted array is a binary trie: a node is a range of it whose members share their first
    bits. Pairs of nodes go down together; where one goes left and the other right a differing
    bit is added, and a pair over the budget is dropped with everything below. ``within``: both
    arrays are the same, and of each pair one order is enough. Parts are walked depth first, so
    memory follows CHUNK_PAIRS and not the number of pairs.
    """
    if not len(left) or not len(right):
        return
    todo = [(0, np.zeros(1, np.int64), np.full(1, len(left)), np.zeros(1, np.int64), np.full(1, len(right)), np.zeros(1, np.int64))]
    while todo:
        depth, a0, a1, b0, b1, spent = todo.pop()
        if len(a0) > CHUNK_PAIRS:
            half = len(a0) // 2
            todo += [(depth, *(x[part] for x in (a0, a1, b0, b1, spent))) for part in (slice(half), slice(half, None))]
            continue
        sizes = (a1 - a0) * (b1 - b0)
        done = (sizes <= LEAVES) | (depth == bits)
        if done.any():
            some = _cut(*(x[done] for x in (a0, a1, b0, b1)))
            leaves = (some[1] - some[0]) * (some[3] - some[2])
            for at in _parts(leaves):
                base = [x[at] for x in (some[0], some[2], some[3])]
                n = leaves[at]
                pair = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
                wide = (base[2] - base[1])[pair]
                i, j = base[0][pair] + k // wide, base[1][pair] + k % wide
                near = np.bitwise_count(left[i] ^ right[j]) <= budget
                if within:
                    near &= i < j
                yield i[near], j[near]
        a0, a1, b0, b1, spent = (x[~done] for x in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit = np.uint64(1 << (63 - depth))
        ma, mb = _middle(left, a0, a1, bit), _middle(right, b0, b1, bit)
        nexts = []
        for x0, x1, y0, y1, more in ((a0, ma, b0, mb, 0), (ma, a1, mb, b1, 0), (a0, ma, mb, b1, 1), (ma, a1, b0, mb, 1)):
            ok = (x0 < x1) & (y0 < y1) & (spent + more <= budget)
            if within:
                ok &= x0 < y1
            nexts.append((x0[ok], x1[ok], y0[ok], y1[ok], spent[ok] + more))
        todo.append((depth + 1, *(np.concatenate(x) for x in zip(*nexts, strict=True))))


def _cut(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, ...]:
    """The node pairs, those of more than CHUNK_PAIRS leaves cut into several by their left node."""
    step = np.maximum(1, CHUNK_PAIRS // (b1 - b0))
    pieces = -(-(a1 - a0) // step)
    if (pieces == 1).all():
        return a0, a1, b0, b1
    pair = np.repeat(np.arange(len(a0)), pieces)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = a0[pair] + k * step[pair]
    return start, np.minimum(start + step[pair], a1[pair]), b0[pair], b1[pair]


def _parts(sizes: np.ndarray):
    """Slices of the pairs, each with about CHUNK_PAIRS leaves or one pair."""
    ends = np.cumsum(sizes)
    cuts = np.searchsorted(ends, np.arange(CHUNK_PAIRS, ends[-1] + CHUNK_PAIRS, CHUNK_PAIRS))
    at = 0
    for cut in np.minimum(cuts + 1, len(sizes)):
        if cut > at:
            yield slice(at, cut)
            at = cut


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """For each range of a sorted array, whose members agree before ``bit``, where the bit turns 1."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = (values[np.minimum(mid, len(values) - 1)] & bit) != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def levels(total: int, block: int = BLOCK) -> int:
    """Levels of the trie that are walked as a join, so that a cell holds about a block."""
    return min(16, max(LEVELS, math.ceil(math.log2(max(total, 1) / block))))


def dealt(celled: DataFrame, key: str, depth: int, budget: int, block: int = BLOCK) -> DataFrame:
    """The rows (trie, cell, ...) once for each unit (trie, cell, other, i, j) and side they take part in.

    A cell is a prefix of ``depth`` bits, and only cells of a trie whose prefixes are within the
    budget meet. A cell with more than a block of rows is dealt into blocks by a hash of ``key``,
    so one crowded cell fills many tasks.
    """
    rest = [c for c in celled.columns if c not in ("trie", "cell")]
    blocks = celled.groupBy("trie", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    masks = [m for m in range(1 << depth) if m.bit_count() <= budget]
    cells = blocks.select("trie", "cell", F.explode(F.array(*[F.lit(m).cast("bigint") for m in masks])).alias("mask"), "blocks")
    other = blocks.select("trie", F.col("cell").alias("other"), F.col("blocks").alias("other_blocks"))
    pairs = cells.withColumn("other", F.col("cell").bitwiseXOR(F.col("mask"))).where("cell <= other").join(other, ["trie", "other"])
    units = pairs.select("trie", "cell", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), "other_blocks")
    units = units.select("trie", "cell", "other", "i", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("j")).where("cell < other or i <= j")
    mine = celled.join(blocks, ["trie", "cell"]).select("trie", F.col("cell").alias("c"), F.pmod(F.xxhash64(key), F.col("blocks")).cast("int").alias("b"), *rest)
    sides = units.select("trie", F.col("cell").alias("c"), F.col("i").alias("b"), F.lit(0).alias("side"), "cell", "other", "i", "j").union(
        units.where("cell < other or i < j").select("trie", F.col("other"), F.col("j"), F.lit(1), "cell", "other", "i", "j")
    )
    # Every unit is met by all rows of a block: the join key is (trie, cell, block).
    return sides.join(mine, ["trie", "c", "b"]).select("trie", "cell", "other", "i", "j", "side", *rest)


def near_fingerprint_links(distinct: DataFrame, budget: int = 2, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that connect the same fingerprints as all pairs within the bit budget would.

    ``distinct`` has one row for each fingerprint ``fp``. The trie's top levels are walked as a
    join, the rest in tasks. Each task returns a spanning forest of what it linked, at most one
    edge for each of its fingerprints, so a large group never becomes all its pairs.
    """
    depth = levels(distinct.count(), block)
    celled = distinct.select(F.lit(0).alias("trie"), F.shiftrightunsigned("fp", 64 - depth).alias("cell"), "fp")

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        side = rows["side"].to_numpy()
        left = np.sort(fp[side == 0])
        right = np.sort(fp[side == 1])
        alone = not len(right)
        forest = Forest(len(left) + len(right))
        for i, j in trie_pairs(left, left if alone else right, budget, alone):
            forest.add(i, j if alone else j + len(left))
        child, root = forest.edges()
        both = np.concatenate([left, right]).view(np.int64)
        return pd.DataFrame({"a": both[child], "b": both[root]})

    return dealt(celled, "fp", depth, budget, block).groupBy("trie", "cell", "other", "i", "j").applyInPandas(unit, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 3, budget: int = 2, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id, kept) for every row of the documents.

    Documents link when their fingerprints differ in at most ``budget`` bits; a component holds
    all that links reach, and its id is its least document id. Equal fingerprints form one class
    before any pair is made, so copies cost no pairs. Rows with equal ids are rows of their own
    and share a component when their texts do; a null id is never the least unless all are null.
    Null or blank texts have fingerprint zero, linked like any other. Extra columns are ignored.
    An empty table gives no rows.
    """
    marked = fingerprints(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")), width).select("doc_id", "fp")
    marked = table_copy(marked, "simhash")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(near_fingerprint_links(distinct.select("fp"), budget)).withColumnRenamed("node", "fp")
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(best, "root").select("fp", "component_id")
    return marked.join(by_fp, "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
    )


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, as ``near_duplicates`` finds them."""
    return near_duplicates(read(spark, sf_dir, "documents"))
