import math

import numpy as np
from util import rows

from recollect.llm import embedding_dedup as e

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(vectors, limit=0.98):
    n = len(vectors)
    root = list(range(n))
    links = [0] * n

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    def usable(v, label):
        return label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)

    for a in range(n):
        for b in range(a):
            va, vb = vectors[a][1], vectors[b][1]
            if vectors[a][2] == vectors[b][2] and usable(va, vectors[a][2]) and usable(vb, vectors[b][2]) and len(va) == len(vb):
                x, y = np.array(va, np.float32).astype(float), np.array(vb, np.float32).astype(float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= limit:
                    links[a] += 1
                    links[b] += 1
                    root[find(a)] = find(b)
    least = {}
    for k in range(n):
        least[find(k)] = min(vectors[k][0], least.get(find(k), vectors[k][0]))
    return sorted((vectors[k][0], links[k], least[find(k)]) for k in range(n))


def planted(seed=0, groups=60, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.standard_normal(dim)
        for k in range(int(rng.integers(1, 6))):
            noise = rng.standard_normal(dim) * np.linalg.norm(base) / math.sqrt(dim) * rng.choice([0.0, 0.1, 0.18, 0.3])
            out.append((base + noise * (k > 0)).astype(np.float32).tolist())
    return [(k, v, int(rng.integers(0, 3))) for k, v in enumerate(out)]


def test_links_match_brute_force(spark):
    vectors = planted()
    n = len(vectors)
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] * 16, [None] + [1.0] * 15, [], vectors[0][1], vectors[0][1], [2 * x for x in vectors[0][1]], vectors[0][1][:8]]
    vectors += [(n + k, v, vectors[0][2]) for k, v in enumerate(odd)] + [(n + 20, vectors[0][1], None)]
    df = spark.createDataFrame(vectors, SCHEMA).selectExpr("*", "'x' as rep", "1 as n", "2 as links")
    for block in (e.BLOCK, 16, 3):
        found = e.near_vectors(df, block=block)
        assert rows(found, "vec_id", "n_links", "component_id") == sorted(brute(vectors), key=str)
        assert all(k == (v == c) for v, c, k in rows(found, "vec_id", "component_id", "kept"))


def test_rows_with_equal_ids_are_vectors_of_their_own(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    vectors = [(1, a, 0), (1, b, 0), (2, [1.0, 0.01], 0), (3, a, 1), (4, b, 1), (1, b, 1), (5, b, None)]
    vectors += [(k % 30, v, l) for k, v, l in planted(3, 40)]
    found = e.near_vectors(spark.createDataFrame(vectors, SCHEMA))
    assert rows(found, "vec_id", "n_links", "component_id") == sorted(brute(vectors), key=str)


def test_tables_keep_the_recall_and_thin_out_cells():
    assert e.tables(e.BLOCKS * e.BLOCK, 0.98) == (0, 1)
    rng = np.random.default_rng(8)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((4000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * side
    for total in (20_000, 100_000, 10**7):
        depth, count = e.tables(total, 0.98)
        x, y = e.cells(a, depth, count, 1), e.cells(b, depth, count, 1)
        assert (x == y).any(1).mean() >= 0.998
        assert (x == np.roll(y, 1, 0)).mean() <= 3 * e.BLOCK / total
        assert count < 40


def test_no_rows(spark):
    assert e.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_calibration_keeps_the_recall_at_the_limit():
    width, least = e.calibrated(0.98, 0.9999, 40, 1.0)
    p = math.erf(1 / math.sqrt(2))
    tail = lambda t: sum(math.comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(t, 41))
    assert tail(least) >= 0.9999 > tail(least + 1) and width > 0.2


def test_pairs_at_the_limit_are_found_and_far_ones_rarely_verified():
    rng = np.random.default_rng(5)
    width, least = e.calibrated(0.98, 0.9999, 40, 1.0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((2000, 64))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.981 * a + math.sqrt(1 - 0.981**2) * side
    found = dict(e.colliding(a, b, rng.standard_normal((64, 40)), width, least, False))
    assert sum(q in found.get(q, ()) for q in range(2000)) >= 1998
    assert sum(map(len, found.values())) < 2000 * 2000 * 0.01


def test_vectors_without_an_id_link_like_others(spark):
    near, apart = [1.0, 2.0, 3.0], [-3.0, 1.0, 0.5]
    df = spark.createDataFrame([(None, near, 1), (1, near, 1), (2, [1.0, 2.0, 3.01], 1), (None, apart, 1), (None, apart, 1), (None, None, 1), (None, near, None)], SCHEMA)
    want = [(None, 2, 1, False), (1, 2, 1, True), (2, 2, 1, False), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True), (None, 0, None, True)]
    for block in (e.BLOCK, 1):
        assert rows(e.near_vectors(df, block=block), "vec_id", "n_links", "component_id", "kept") == sorted(want, key=str)


def test_cells_are_the_same_for_any_number_of_vectors_and_any_block(spark, monkeypatch):
    asked, before = [], e.tables
    monkeypatch.setattr(e, "tables", lambda *of: asked.append(of) or before(*of))
    for groups, block in ((2, e.BLOCK), (20, 8)):
        e.near_vectors(spark.createDataFrame(planted(1, groups), SCHEMA), block=block)
    assert len(asked) == 2 and asked[0] == asked[1]
