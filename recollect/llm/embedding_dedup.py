"""Embedding near-duplicates by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import Forest, components, read, table_copy

#: Vectors of a block; a task counts collisions between two blocks.
BLOCK = 2048
#: Width of a cell of a projection on a standard normal direction, the probability with which a
#: pair at the limit shares a cell of some table, and the blocks from which on tables save work.
CELL, SHARED, BLOCKS = 1.5, 0.9995, 8
#: Vectors of a label that cells and tables are made for, whatever an input holds: whether a pair is
#: found does not depend on the other vectors, nor on the size of blocks.
DEALT = 1 << 15


def calibrated(cosine: float, recall: float, projections: int, half_width: float) -> tuple[float, int]:
    """(half-width of a window, collisions asked for) of unit vectors at the limit cosine.

    A pair at the limit lies ``d = sqrt(2 - 2 cosine)`` apart, so its projections on a standard
    normal direction differ by N(0, d) and meet in a window of ``half_width * d`` with the
    probability p. Of ``projections`` directions, a binomial number collide; the count is the
    largest that at least ``recall`` of such pairs reach. Closer pairs reach it more often.
    """
    d = math.sqrt(max(0.0, 2 - 2 * cosine))
    p = math.erf(half_width / math.sqrt(2))
    tail, count = 1.0, 0
    while count < projections:
        tail -= math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail < recall:
            break
        count += 1
    return half_width * d + 1e-9, count


def colliding(left: np.ndarray, right: np.ndarray, directions: np.ndarray, width: float, least: int, within: bool):
    """For each row of left, the rows of right that fall into at least ``least`` of its windows.

    Each projection of ``right`` is sorted once; a query's window is then a run of that order,
    and its members get one count.
    """
    shadow = right @ directions
    order = np.argsort(shadow, axis=0, kind="stable")
    ranked = np.take_along_axis(shadow, order, axis=0)
    query = left @ directions
    lo = np.stack([np.searchsorted(ranked[:, k], query[:, k] - width) for k in range(directions.shape[1])], axis=1)
    hi = np.stack([np.searchsorted(ranked[:, k], query[:, k] + width, "right") for k in range(directions.shape[1])], axis=1)
    runs = [np.ascontiguousarray(order[:, k]) for k in range(directions.shape[1])]
    count = np.zeros(len(right), np.int16)
    for q in range(len(left)):
        count[:] = 0
        for k, run in enumerate(runs):
            count[run[lo[q, k] : hi[q, k]]] += 1
        near = np.flatnonzero(count >= least)
        if within:
            near = near[near > q]
        if len(near):
            yield q, near


def together(distance: float, cell: float = CELL) -> float:
    """The probability that two unit vectors at a distance share a cell of one projection."""
    x = cell / distance
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def tables(total: int, cosine: float, block: int = BLOCK, shared: float = SHARED) -> tuple[int, int]:
    """(projections of a table's cells, tables) for so many vectors of a label.

    As many projections make a cell as bring unrelated vectors down to a block, and as many
    tables are kept as let a pair at the limit share a cell of one with the probability
    ``shared``. Up to BLOCKS blocks, where that would cost more than it saves: one table of one
    cell, in which all blocks meet.
    """
    near, far = together(max(1e-6, math.sqrt(max(0.0, 2 - 2 * cosine)))), together(math.sqrt(2))
    depth = max(0, math.ceil(math.log(total / block) / -math.log(far))) if total > BLOCKS * block else 0
    miss = 1 - near**depth
    return depth, 1 if miss <= 1 - shared else math.ceil(math.log(1 - shared) / math.log(miss))


def cells(v: np.ndarray, depth: int, count: int, seed: int) -> np.ndarray:
    """The cell of each unit vector in each table, as a hash."""
    rng = np.random.default_rng([seed, depth, count, v.shape[1]])
    out = np.empty((len(v), count), np.int32)
    for t in range(count):
        at = np.floor(v @ rng.standard_normal((v.shape[1], depth)) / CELL + rng.random(depth)).astype(np.int64).view(np.uint64)
        h = np.full(len(v), t, np.uint64)
        for k in range(depth):
            h = (h ^ at[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def unit_rows(v: pd.Series) -> np.ndarray:
    """The vectors in double precision and of length 1."""
    out = np.array(v.to_list(), float)
    out /= np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame,
    cosine: float = 0.98,
    recall: float = 0.9999,
    projections: int = 40,
    half_width: float = 1.0,
    block: int = BLOCK,
    seed: int = 11,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector.

    Vectors are compared when their labels are equal and not null. They link at a cosine of at
    least ``cosine``, computed in double precision for every pair that enough projections bring
    together; a pair at the limit is brought together with the probability ``recall``. A label of
    whatever size is first dealt into the cells of several tables, each made by a few other
    projections; a pair counts in the first table whose cell it shares, and one at the limit
    shares none with the probability 1 - SHARED. A crowded cell is dealt into blocks. What is
    found of a pair depends on its two vectors alone.

    Null or zero vectors, and vectors with a null or non-finite component, link with nothing;
    vectors of other lengths are other groups. Equal vectors of a label form one class first, and
    a pair of blocks returns sums of links and a spanning forest, never its pairs. Rows with
    equal vec_ids, or null ones, are vectors of their own, whose component names the least id it
    holds; one without any id has null, and keeps all its rows, as no id tells them apart. Extra
    columns are ignored; no rows give no rows. A vector is in one row, whatever its length.
    """
    width, least = calibrated(cosine, recall, projections, half_width)
    raw = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").alias("label"), raw.alias("v"))
    # NaN and infinity times zero are NaN; null makes the sum null.
    flat = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * F.lit(0.0))
    some = F.exists("v", lambda x: x != 0)
    usable = F.col("label").isNotNull() & F.coalesce(flat == 0, F.lit(False)) & F.coalesce(some, F.lit(False))
    rows = rows.withColumn("class", F.when(usable, F.xxhash64("label", "v")))
    classes = rows.where("class is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = table_copy(classes.withColumn("rep", F.monotonically_increasing_id()), "vectors")

    depth, count = tables(DEALT, cosine)

    @F.pandas_udf("array<int>")
    def celled(v: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(v), index=v.index, dtype=object)
        for _, part in v.groupby(v.str.len()):
            out[part.index] = list(cells(unit_rows(part), depth, count, seed))
        return out

    placed = classes.select("label", F.size("v").alias("dim"), "rep", "n", "v", celled("v").alias("cells"))
    placed = table_copy(placed, "cells")
    spots = placed.select("label", "dim", "rep", F.posexplode("cells").alias("table", "cell"))
    # A cell with one vector has no pairs.
    key = ["label", "dim", "table", "cell"]
    sizes = spots.groupBy(*key).agg(F.count("*").alias("size")).where("size > 1").select(*key, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    units = sizes.select(*key, "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i")).select(*key, "i", F.explode(F.sequence("i", F.col("blocks") - 1)).alias("j"))
    sides = units.select(*key, F.col("i").alias("b"), F.lit(0).alias("side"), "i", "j").union(units.where("i < j").select(*key, "j", F.lit(1), "i", "j"))
    own = placed.select("label", "dim", F.posexplode("cells").alias("table", "cell"), "rep", "n", "v", "cells").join(sizes, key)
    own = own.withColumn("b", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).drop("blocks")
    dealt = sides.join(own, [*key, "b"]).select(*key, "i", "j", "side", "rep", "n", "v", "cells")

    def unit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "rep"], kind="stable")
        unit_v = unit_rows(rows["v"])
        n, rep, table = rows["n"].to_numpy(), rows["rep"].to_numpy(), int(rows["table"].iloc[0])
        before = np.array(rows["cells"].to_list())[:, :table]
        cut = int((rows["side"] == 0).sum())
        # Not by the sides: a block may be empty, and its partner must not be compared with itself again.
        alone = bool(rows["i"].iloc[0] == rows["j"].iloc[0])
        directions = np.random.default_rng(seed).standard_normal((unit_v.shape[1], projections))
        left, start = unit_v[:cut], 0 if alone else cut
        right = unit_v[start:]
        links, forest = np.zeros(len(rows), np.int64), Forest(len(rows))
        pairs_a, pairs_b, held = [], [], 0
        for q, near in colliding(left, right, directions, width, least, alone):
            near = near[right[near] @ left[q] >= cosine] + start
            near = near[(before[near] != before[q]).all(1)]
            if len(near):
                links[q] += n[near].sum()
                links[near] += n[q]
                pairs_a.append(np.full(len(near), q))
                pairs_b.append(near)
                held += len(near)
                if held > 1 << 18:
                    forest.add(np.concatenate(pairs_a), np.concatenate(pairs_b))
                    pairs_a, pairs_b, held = [], [], 0
        if pairs_a:
            forest.add(np.concatenate(pairs_a), np.concatenate(pairs_b))
        some = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[some], "links": links[some], "root": rep[forest.root[some]]})

    found = table_copy(dealt.groupBy(*key, "i", "j").applyInPandas(unit, "rep bigint, links bigint, root bigint"), "links")
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reach = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = (
        classes.join(linked, "rep", "left")
        .join(reach.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    by_class = table_copy(by_class, "linked")
    named = by_class.join(by_class.groupBy("root").agg(F.min("least").alias("component_id")), "root").withColumn("class", F.xxhash64("label", "v"))
    same = (F.col("r.class") == F.col("c.class")) & (F.col("r.label") == F.col("c.label")) & (F.col("r.v") == F.col("c.v"))
    joined = rows.alias("r").join(named.alias("c"), same, "left")
    component = F.coalesce("c.component_id", "r.vec_id")
    return joined.select(
        F.col("r.vec_id").alias("vec_id"),
        F.coalesce("c.n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"),
        F.col("r.vec_id").eqNullSafe(component).alias("kept"),
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component, as ``near_vectors`` finds them."""
    return near_vectors(read(spark, sf_dir, "embeddings"))
