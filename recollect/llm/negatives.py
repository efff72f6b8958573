"""Hard negatives by a Voronoi-partitioned nearest-neighbour join of anchors with all vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.llm.common import read, table_copy

#: Anchors and candidates of a block; a task joins one block of each.
ANCHORS, CANDIDATES = 256, 2048
#: Anchors for each pivot, and pivots at most, of the vectors of a length. Pivots are the only
#: vectors that the driver sees.
PER_PIVOT, PIVOTS = 128, 256
#: Up to this many rows of partition bounds (some 16 MB) are broadcast.
BROADCAST_BOUNDS = 200_000
#: Rows of a label and cell whose distances to the pivot bound a neighbour's distance.
WITNESSES = 8

KEY = ["dim", "cell", "block", "part"]


def products(left: list, right: list) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond 64 bits stay at its limits."""
    a, b = np.array(left, float), np.array(right, float)
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in left], object) @ np.array([[int(x) for x in r] for r in right], object).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def whole_vectors(vectors: DataFrame, label: Column, anchor: Column, scale: int, id_col: str = "vec_id") -> DataFrame:
    """(row, vec_id, nameless, tie, label, anchor, dim, v, norm) of usable rows, with components floor(scale * x) and their squared length.

    tie orders equal scores: the id, or where the row is nameless the largest number.
    """
    raw = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), raw.alias("x"))
    # NaN and infinity times zero are NaN; null makes the sum null.
    flat = F.aggregate("x", F.lit(0.0), lambda s, x: s + x * F.lit(0.0))
    rows = rows.where(F.col("label").isNotNull() & F.coalesce(flat == 0, F.lit(False)))
    v = F.transform("x", lambda x: F.floor(x * scale).cast("bigint"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("vec_id").isNull().alias("nameless"), F.coalesce("vec_id", F.lit(2**63 - 1)).alias("tie"), "label", "anchor", F.size("x").alias("dim"), v.alias("v")).withColumn("norm", norm)


def drawn_pivots(rows: DataFrame, sizes: list) -> dict[int, tuple[np.ndarray, float]]:
    """By vectors' length: the pivots, augmented, and the largest squared length.

    As many pivots as anchors need are drawn by a hash; a length of few anchors has one.
    """
    found = {}
    for s in sizes:
        many = min(PIVOTS, max(1, s["anchors"] // PER_PIVOT))
        if many == 1:
            found[s["dim"]] = (np.zeros((1, s["dim"] + 1)), s["most"])
            continue
        own = rows.where(F.col("dim") == s["dim"]).select("v", "norm", F.xxhash64(F.lit(3), "v").alias("h"))
        first = own.select("h").distinct().orderBy("h").limit(many)
        drawn = own.join(F.broadcast(first), "h").groupBy("h").agg(F.first("v").alias("v"), F.first("norm").alias("norm")).orderBy("h").toPandas()
        found[s["dim"]] = (augmented(drawn["v"], drawn["norm"], s["most"]), s["most"])
    return found


def augmented(v: pd.Series, norm: pd.Series, most: float) -> np.ndarray:
    """Candidates with one more component, so that all have the largest length: near means a large inner product."""
    m = np.array(v.to_list(), float).reshape(len(v), -1)
    return np.column_stack([m, np.sqrt(np.maximum(0.0, most - norm.to_numpy(float)))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)
    return np.sqrt(np.maximum(0.0, square))


def partitioned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, anchors): the rows with their distances to all pivots, and the nearest pivot as cell.

    An anchor has 0 as its further component, so its squared distance to a candidate is |q|^2 + M^2 - 2 q x,
    M being the largest length of the vectors with its number of components. Distances are kept
    to single precision; bounds allow for that.
    """
    sizes = rows.groupBy("dim").agg(F.count_if("anchor").alias("anchors"), F.max("norm").alias("most")).where("anchors > 0").collect()
    pivots = drawn_pivots(rows, sizes)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def measured(as_anchor: bool):
        @F.pandas_udf("array<float>")
        def far(v: pd.Series, norm: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(v), index=v.index, dtype=object)
            for dim, part in v.groupby(v.str.len()):
                if dim in sent.value:
                    at, most = sent.value[dim]
                    points = augmented(part, norm[part.index], most)
                    if as_anchor:
                        points[:, -1] = 0.0
                    out[part.index] = list(distances(points, at).astype(np.float32))
            return out

        return far("v", "norm")

    def placed(df: DataFrame, as_anchor: bool) -> DataFrame:
        return df.withColumn("far", measured(as_anchor)).where("far is not null").withColumn("cell", (F.array_position("far", F.array_min("far")) - 1).cast("int"))

    most = rows.sparkSession.createDataFrame([(d, float(m)) for d, (_, m) in pivots.items()], "dim int, most double")
    candidates = table_copy(placed(rows, False).drop("anchor"), "candidates")
    anchors = placed(rows.where("anchor"), True).drop("anchor").join(F.broadcast(most), "dim")
    counts = anchors.groupBy("dim", "cell").agg(F.ceil(F.count("*") / ANCHORS).alias("blocks"))
    anchors = anchors.join(counts, ["dim", "cell"]).withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).drop("blocks")
    return candidates, table_copy(anchors, "anchors")


def served(candidates: DataFrame, bounds: DataFrame, *by: str) -> DataFrame:
    """(row, dim, cell, part) for each cell of anchors that a candidate might serve.

    bounds (dim, cell, *by, bound): a candidate farther from a cell's pivot than the bound is too far
    from each anchor in it, by the triangle inequality. A cell's candidates are dealt into parts
    of CANDIDATES rows about. Bounds are broadcast up to BROADCAST_BOUNDS rows, and shuffled beyond.
    """
    bounds = table_copy(bounds, "bounds")
    bounds = bounds.withColumnRenamed("cell", "to")
    bounds = F.broadcast(bounds) if bounds.count() <= BROADCAST_BOUNDS else bounds
    slim = candidates.select("row", "dim", "far", *by).hint("merge")
    reached = slim.join(bounds, ["dim", *by]).where(F.get("far", F.col("to")) <= F.col("bound")).select("row", "dim", F.col("to").alias("cell"))
    counts = reached.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CANDIDATES).alias("parts"))
    return reached.join(F.broadcast(counts), ["dim", "cell"]).select("row", "dim", "cell", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"), "parts")


def slack(distance: Column) -> Column:
    """A bound with room for single precision and rounding."""
    return distance * 1.000001 + F.sqrt("most") * 1e-5


def joined(anchors: DataFrame, candidates: DataFrame, copies: DataFrame, local, schema: str) -> DataFrame:
    """What ``local`` finds between each block of anchors and each part of the candidates of its cell."""
    copies = table_copy(copies, "copies")
    parts = copies.groupBy("dim", "cell").agg(F.max("parts").alias("parts"))
    left = anchors.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")
    blocks = anchors.groupBy("dim", "cell").agg((F.max("block") + 1).alias("blocks"))
    right = copies.drop("parts").join(F.broadcast(blocks), ["dim", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    # A file of copies, or of short whole vectors, is many times smaller than its rows: by its size Spark would send one of them through the driver.
    right = right.join(candidates.select("row", "tie", "nameless", "label", "v").hint("merge"), "row")
    return left.groupBy(*KEY).cogroup(right.groupBy(*KEY)).applyInPandas(local, schema)


def best_first(candidates: pd.DataFrame) -> pd.DataFrame:
    """Candidates in the order of ties: by id, those without one last, then by row."""
    return candidates.sort_values(["tie", "nameless", "row"], kind="stable")


#: What a local join returns of a candidate.
FOUND = "row bigint, tie bigint, nameless boolean, score bigint"


def taken(c: pd.DataFrame, at: np.ndarray, score: np.ndarray, **of) -> pd.DataFrame:
    """The candidates at some places, with their scores, as rows of an anchor."""
    return pd.DataFrame({**of, "row": c["row"].to_numpy()[at], "tie": c["tie"].to_numpy()[at], "nameless": c["nameless"].to_numpy()[at], "score": score[at]})


def table_of(parts: list[pd.DataFrame], *names: str) -> pd.DataFrame:
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in (*names, "row", "tie", "nameless", "score")})


def first_rows(found: DataFrame, most: int, *by: str) -> DataFrame:
    """The first rows by score and tie of each group, with their place from 1."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "tie", "nameless", "row")
    named = found.withColumn("vec_id", F.when(~F.col("nameless"), F.col("tie")))
    return named.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def nearest_same(anchors: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """(anchor, row, vec_id, score, place): each anchor's first ``most`` other rows of its label.

    An anchor's neighbours lie no farther than the (most + 1)-th least of |q, p| + |p, x| over rows
    x of its label with known distances to their pivots p: so many rows are that near, one of which may be the
    anchor itself. The least distance of each of WITNESSES parts of a cell is such a row.
    """
    nearest = candidates.groupBy("dim", "label", "cell", F.pmod(F.xxhash64("row"), F.lit(WITNESSES)).alias("w")).agg(F.min(F.get("far", F.col("cell"))).alias("d"))
    near = nearest.groupBy("dim", "label").agg(F.collect_list(F.struct("cell", "d")).alias("near"))
    near = F.broadcast(near) if near.count() * PIVOTS <= BROADCAST_BOUNDS else near
    ways = F.sort_array(F.transform("near", lambda e: F.get(F.col("far"), e["cell"]) + e["d"]))
    reach = F.coalesce(F.get(ways, F.lit(most)), F.lit(float("inf")))
    bounded = anchors.join(near, ["dim", "label"]).select("dim", "cell", "label", slack(F.get("far", F.col("cell")) + reach).alias("bound"))
    bounds = bounded.groupBy("dim", "cell", "label").agg(F.max("bound").alias("bound"))

    def local(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            c = best_first(c)
            score = products(a["v"].to_list(), c["v"].to_list())
            label, row = c["label"].to_numpy(), c["row"].to_numpy()
            for k, (own, of) in enumerate(zip(a["row"], a["label"], strict=True)):
                at = np.flatnonzero((label == of) & (row != own))
                at = at[np.argsort(-score[k, at], kind="stable")[:most]]
                out.append(taken(c, at, score[k], anchor=own))
        return table_of(out, "anchor")

    copies = served(candidates, bounds, "label")
    found = joined(anchors.select("row", "dim", "cell", "block", "label", "v"), candidates, copies, local, f"anchor bigint, {FOUND}")
    return first_rows(found, most, "anchor")


def nearest_other(anchors: DataFrame, candidates: DataFrame, positives: DataFrame, most: int, low: int, high: int) -> DataFrame:
    """(anchor, positive, row, vec_id, score, place): by anchor and place of its positive, the first ``most`` rows of other labels.

    A row serves if low * p <= high * score <= high * p, p being the positive's score. So the least of
    the positives' scores that are not negative gives each anchor a radius, and a cell of anchors a bound.
    """
    wanted = positives.where("score >= 0").groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("positives"))
    asking = table_copy(anchors.join(wanted, anchors["row"] == wanted["anchor"]).drop("anchor"), "asking")
    least = F.array_min(F.transform("positives", lambda p: p["score"])).cast("double") * low / high
    square = F.greatest(F.lit(0.0), F.col("norm") + F.col("most") - 2 * least)
    bounds = asking.groupBy("dim", "cell").agg(F.max(slack(F.get("far", F.col("cell")) + F.sqrt(square))).alias("bound"))

    def local(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(c):
            c = best_first(c)
            score = products(a["v"].to_list(), c["v"].to_list())
            label = c["label"].to_numpy()
            for k, (own, of, positives) in enumerate(zip(a["row"], a["label"], a["positives"], strict=True)):
                other = np.flatnonzero((label != of) & (score[k] >= 0))
                other = other[np.argsort(-score[k, other], kind="stable")]
                values = score[k, other]
                for p in positives:
                    # Scores fall: what serves a positive is a run of them.
                    start = np.searchsorted(-values, -p["score"])
                    at = other[start : start + most]
                    at = at[[high * int(s) >= low * int(p["score"]) for s in score[k, at]]] if len(at) else at
                    if len(at):
                        out.append(taken(c, at, score[k], anchor=own, positive=p["place"]))
        return table_of(out, "anchor", "positive")

    copies = served(candidates, bounds)
    found = joined(asking.select("row", "dim", "cell", "block", "label", "v", "positives"), candidates, copies, local, f"anchor bigint, positive int, {FOUND}")
    return first_rows(found, most, "anchor", "positive")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column | None = None,
    label: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of each anchor and positive.

    Anchors are the rows where ``anchor`` is true (by default ids divisible by 100). Components x
    become floor(scale * x); a score is a whole inner product; equal scores rank by id, null ids last. An
    anchor's positives are its first other rows of its label. For each, its first rows of other labels with
    low * positive <= high * negative <= high * positive are returned; a negative positive's score leaves none.

    The join is exact: anchors and candidates are dealt to cells of pivots in the space in which
    a large inner product is a small distance; a candidate is sent to the cells of anchors only that the
    partition bounds let it serve. Blocks of at most some ANCHORS and CANDIDATES rows meet in a task,
    whatever the label, cell or copies, and return the first rows of each anchor.

    Rows with a null label or vector, or a null or non-finite component, take no part; vectors
    meet only those of their length. An empty vector scores 0. Rows with equal or null ids are rows of their own; an anchor has an
    id. Scores beyond 64 bits stay at its limits. Extra columns are ignored; no rows give none.
    """
    anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    rows = table_copy(whole_vectors(vectors, F.col("label") if label is None else label, anchor, scale), "whole-vectors")
    candidates, anchors = partitioned(rows)
    same = table_copy(nearest_same(anchors, candidates, positives), "positives")
    found = nearest_other(anchors, candidates, same, negatives, low, high)
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    chosen = same.select("anchor", F.col("place").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(chosen, ["anchor", "positive"]).join(named, "anchor").select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of ``embeddings``; where vec_id is divisible by 7 the label is the next of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), label=moved)
