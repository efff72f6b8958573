import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from util import same_as_sql, saved

from recollect.llm import negatives as m
from recollect.llm import sql

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives=5):
    """What the contract says, pair by pair, in whole numbers."""
    usable = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    order = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for k, (i, v, label) in enumerate(usable):
        if i is None or i % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, n, other) for n, (j, w, other) in enumerate(usable) if n != k and len(w) == len(v)]
        same = sorted((r for r in scored if r[3] == label), key=order)[:positives]
        for p, j, *_ in same:
            fits = sorted((r for r in scored if r[3] != label and 80 * p <= 100 * r[0] <= 100 * p), key=order)[:negatives]
            out += [(i, j, r + 1, f[1], p, f[0]) for r, f in enumerate(fits)]
    return sorted(out, key=str)


def clustered(seed, n, dim, groups, labels, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    at = rng.integers(0, groups, n)
    v = centres[at] + spread * rng.standard_normal((n, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(k, [float(x) for x in v[k].astype(np.float32)], int(at[k] * 7 + rng.integers(0, 2)) % labels) for k in range(n)]


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("cell", F.lit(None).cast("int")).withColumn("score", F.lit(1))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r) for r in m.hard_negatives(frame, label=moved, **options).collect()), key=str)


def test_given_vectors_and_sql(spark, tmp_path):
    same_as_sql(m.op11_hard_negatives(spark, "/root/testdata/sf0.01"), "/root/testdata/sf0.01", sql.OP11.replace("FROM embeddings", "FROM '/root/testdata/sf0.01/embeddings.parquet'"), [])


@pytest.mark.parametrize("spread", [0.05, 0.5])
def test_many_cells_and_blocks(spark, monkeypatch, spread):
    """A few anchors for each pivot, and small blocks: the same rows as pair by pair."""
    monkeypatch.setattr(m, "PER_PIVOT", 2)
    monkeypatch.setattr(m, "ANCHORS", 3)
    monkeypatch.setattr(m, "CANDIDATES", 100)
    rows = clustered(3, 3000, 8, 12, 4, spread)
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(m, "BROADCAST_BOUNDS", 0)
    assert found(spark, rows) == brute(rows)


def test_bounds_leave_far_cells_out(spark, monkeypatch):
    monkeypatch.setattr(m, "PER_PIVOT", 2)
    frame = spark.createDataFrame(clustered(5, 4000, 8, 20, 10, 0.02), SCHEMA)
    rows = m.table_copy(m.whole_vectors(frame, F.col("label"), F.col("vec_id") % 100 == 0, 256), "test")
    candidates, anchors = m.partitioned(rows)
    cells = anchors.select("cell").distinct().count()
    same = m.nearest_same(anchors, candidates, 5)
    assert same.count() == 5 * 40
    bounds = []
    real = m.served
    monkeypatch.setattr(m, "served", lambda c, b, *by: bounds.append(real(c, b, *by).count()) or real(c, b, *by))
    m.nearest_other(anchors, candidates, m.table_copy(same, "same"), 5, 80, 100).count()
    assert cells >= 10 and bounds[0] < 0.5 * cells * 4000


def test_odd_rows(spark):
    e = [1.0, 0.5, -0.25]
    rows = [(k, [1.0, 0.5 + k / 999, -0.25], k % 3) for k in range(1, 200)]
    rows += [(0, e, 1), (100, e, 1), (100, e, 1), (200, e, None), (300, None, 1), (400, [1.0, None, 0.0], 1), (500, [1.0, float("nan"), 0.0], 1), (600, [float("inf"), 0.0, 0.0], 1)]
    rows += [(None, e, 2), (None, e, 1), (700, [1.0, 2.0], 3), (701, [1.0, 2.0], 1), (702, [1.0, 1.9], 3), (800, [], 3), (801, [], 3), (802, [], 5), (900, [0.0, 0.0, 0.0], 4), (-100, [-1.0, -0.5, 0.25], 6), (101, [-1.0, -0.5, 0.25], 6)]
    rows += [(k, e, 8) for k in range(1000, 1040)] + [(k, e, 9) for k in range(1040, 1100)]
    assert found(spark, rows) == brute(rows)


def test_scores_beyond_64_bits_stay_at_the_limits():
    top = 2**62
    assert m.products([[top, top, top, top]], [[top, 1, 1, 1], [-top, -top, 0, 0], [1, 0, 0, 0]]).tolist() == [[2**63 - 1, 1 - 2**63, top]]


def test_one_common_vector_and_one_label(spark, monkeypatch):
    monkeypatch.setattr(m, "CANDIDATES", 64)
    rows = [(k, [0.6, 0.8], 1) for k in range(1500)] + [(k, [0.8, 0.6], 2) for k in range(1500, 1700)]
    assert found(spark, rows) == brute(rows)


def test_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_small_files_of_many_rows_do_not_go_through_the_driver(spark):
    """By the size of their files Spark broadcast whole vectors, or the copies of a candidate for each cell."""
    vectors = spark.createDataFrame(clustered(3, 400, 4, 4, 3), SCHEMA)
    candidates, anchors = m.partitioned(m.table_copy(m.whole_vectors(vectors, F.col("label"), F.col("vec_id") % 5 == 0, 256), "whole"))
    copies = candidates.select("row", "dim", F.lit(0).alias("cell"), F.lit(0).alias("part"), F.lit(1).alias("parts"))
    joined = m.joined(anchors.select("row", "dim", "cell", "block", "label", "v"), candidates, copies, lambda a, c: c, m.FOUND)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [row" in plan and "BroadcastHashJoin [row" not in plan
