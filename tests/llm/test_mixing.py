import numpy as np
import pytest
from util import DOCS, docs, rows, same_as_sql, saved

from recollect.llm import mixing as m
from recollect.llm import sql


def corpus(spark):
    out = []
    for k in range(300):
        source = [None, "b", "a", "hot", "hot", "hot", "é", "tiny"][k % 8] if k % 8 < 7 or k < 10 else "b"
        out.append((k, " ".join(["w"] * ((k * 37) % 90 + 1)), "en", source, 1))
    out += [(400, None, "en", "a", 0), (401, "", "en", "nothing", 0), (402, " \t\n", "en", "a", 0), (402, " \t\n", "en", "a", 0), (403, "same text", "en", "b", 0), (403, "same text", "en", "b", 0), (None, "no id", "en", "a", 0), (-5, "x " * 5000, "en", "long", 0)]
    return spark.createDataFrame(out, DOCS)


def test_same_as_sql(spark, tmp_path):
    folder = saved(tmp_path, documents=corpus(spark))
    same_as_sql(m.op8_mix_sources(spark, folder), folder, sql.op8(), ["documents"])


def water(sizes, most=3):
    """Targets by sharing again and again, as the contract tells it."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    left, done = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in names if s not in done]
        total = sum(weight[s] for s in open_)
        share = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return done | share
        for s in over:
            done[s] = most * sizes[s]
            left -= done[s]


def surplus(target, total, block=m.BLOCK):
    """Words that a source may be off its target: five deviations of its draw of one shard, and three blocks."""
    shard = max(1, min(m.SHARD, -(-total // block // m.SHARDS)))
    return block * (3 + 5 * (shard * target / total) ** 0.5)


def test_targets_and_taken(spark):
    df = corpus(spark)
    found = m.mixture(df.withColumn("size", m.F.lit(9)).withColumn("block", m.F.lit(9))).collect()
    assert len(found) == df.count()
    sizes = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert 0 <= r.taken <= 3 * r.size
    want = water(sizes)
    for s, size in sizes.items():
        own = [r for r in found if r.source == s]
        assert {r.source_size for r in own} == {size}
        assert own[0].target == pytest.approx(want[s], abs=1e-3)
        assert abs(sum(r.taken for r in own) - want[s]) <= surplus(want[s], sum(want.values()))
    assert sorted(map(str, found)) == sorted(map(str, m.mixture(df.repartition(7)).collect()))


def test_small_buckets_and_blocks(spark):
    found = m.mixture(corpus(spark), block=8, bucket=500).collect()
    want = water({r.source: r.source_size for r in found})
    for s in want:
        assert abs(sum(r.taken for r in found if r.source == s) - want[s]) <= 8 * 30 + 0.02 * want[s] + surplus(want[s], sum(want.values()), 8)
        assert all(r.taken <= 3 * r.size for r in found)


def test_large_permutations_spread_over_their_range(spark):
    n = (1 << 45) + 7
    got = [r.p for r in m.permuted(spark.range(2000), "p", m.F.col("id") * 3, m.F.lit(n), m.F.lit(9)).collect()]
    assert len(set(got)) == 2000 and 0 <= min(got) and max(got) < n
    assert all(150 < sum(q * n // 8 <= x < (q + 1) * n // 8 for x in got) < 350 for q in range(8))


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_permutation_is_one(spark, n):
    df = m.permuted(spark.range(n), "p", m.F.col("id"), m.F.lit(n), m.F.lit(12345))
    got = [r.p for r in df.orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    assert n < 64 or got != list(range(n))


PLAN = "source string, source_rank int, blocks bigint, cap bigint, slots bigint, low bigint, all_slots bigint"


def planned(spark, sizes, blocks=50_000):
    low = [sum(list(sizes.values())[:k]) for k in range(len(sizes))]
    return spark.createDataFrame([(s, k, blocks, 3 * blocks, n, low[k], sum(sizes.values())) for k, (s, n) in enumerate(sizes.items())], PLAN)


def test_draws_of_the_shards_are_multinomial(spark):
    """Sums, means, variances and covariances of the counts that the mix uses."""
    sizes = {"a": 40_000, "b": 9_000, None: 900, "none": 0, "c": 12_100}
    total, n = sum(sizes.values()), 500  # 124 whole shards
    drawn = m.draws(planned(spark, sizes), shard=n).collect()
    shards = total // n
    count = np.zeros((shards, len(sizes)))
    for r in drawn:
        count[r.shard, r.source_rank] = r.drawn
    assert (count.sum(1) == n).all() and count[:, 3].sum() == 0
    p = np.array(list(sizes.values())) / total
    assert (np.abs(count.mean(0) - n * p) <= 4.5 * np.sqrt(n * p * (1 - p) / shards) + 1e-9).all()
    for k in (0, 1, 2, 4):
        spread = ((count[:, k] - n * p[k]) ** 2).sum() / (n * p[k] * (1 - p[k]))
        assert abs(spread - shards) < 4.5 * (2 * shards) ** 0.5
    covariance = ((count[:, 0] - n * p[0]) * (count[:, 4] - n * p[4])).mean()
    assert covariance == pytest.approx(-n * p[0] * p[4], rel=0.5)


def test_counts_carry_what_the_shards_before_drew_too_much(spark, monkeypatch):
    """Against a loop over the shards, also with spans of few shards; sources end near their targets."""
    sizes = {"a": 4_000, "b": 900, None: 90, "few": 3, "c": 1_210}
    frame = planned(spark, sizes)
    total, n = sum(sizes.values()), 50
    totals = set()
    for seed, span in ((1, 4096), (2, 7), (3, 1)):
        monkeypatch.setattr(m, "SPAN", span)
        drawn = {(r.source_rank, r.shard): r.drawn for r in m.draws(frame, shard=n, seed=seed).collect()}
        counts = m.shard_counts(frame, m.draws(frame, shard=n, seed=seed), shard=n).collect()
        for k, (s, slots) in enumerate(sizes.items()):
            want, at = [], 0
            shards = -(-total // n)
            size = -(-total // shards)
            shards = -(-total // size)
            for j in range(shards):
                line = int(slots * j * size / total + 0.5)
                up = line + drawn[k, j] if (k, j) in drawn else line if j == shards - 1 else 0
                if up > at:
                    want.append((j, up - at, at))
                    at = up
            assert sorted((r.shard, r.slots, r.first) for r in counts if r.source == s) == want
            assert abs(at - slots) <= 1 + 5 * (n * slots / total) ** 0.5
        totals.add(tuple(sum(r.slots for r in counts if r.source == s) for s in sizes))
    assert len(totals) == 3


def test_no_source_passes_its_cap(spark):
    frame = planned(spark, {"a": 900, "b": 300}, blocks=100).withColumn("slots", m.F.least("slots", "cap"))
    frame = frame.withColumn("all_slots", m.F.lit(600)).withColumn("low", m.F.when(m.F.col("source") == "a", 0).otherwise(300))
    for seed in range(3):
        got = {r.source: r.n for r in m.shard_counts(frame, m.draws(frame, shard=600, shards=1, seed=seed), 600, 1).groupBy("source").agg(m.F.sum("slots").alias("n")).collect()}
        assert got["a"] <= 300 and got["b"] <= 300 and max(got.values()) == 300


def test_seed_and_shards_decide_what_is_taken(spark):
    df = corpus(spark)
    base = sorted(map(tuple, m.mixture(df).collect()), key=str)
    taken = lambda **o: sorted(map(tuple, m.mixture(df, **o).collect()), key=str)
    assert taken(seed=5) != base and taken(shards=8) != base and taken() == base


def test_slots_follow_the_counts_and_read_each_block_once_in_a_pass(spark):
    counts = spark.createDataFrame([("a", 0, 7, 0, 5, 0), ("a", 0, 7, 1, 9, 5), (None, 1, 3, 1, 2, 0)], "source string, source_rank int, blocks bigint, shard bigint, slots bigint, first bigint")
    slots = m.drawn_slots(counts).collect()
    number = lambda s, k: sum(r.source == s and r.shard == k for r in slots)
    assert [number("a", 0), number("a", 1), number(None, 1)] == [5, 9, 2] and len(slots) == 16
    assert sorted(r.block for r in slots if r.source == "a") == sorted([*range(7)] * 2)


def test_rows_without_ids_and_repeated_rows_are_dealt_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "RUN", 100)
    df = spark.range(5000).selectExpr("cast(null as bigint) as doc_id", "'s' as source", "cast(if(id < 3000, 9, id % 50) as bigint) as size")
    placed, _ = m.packed(df, bucket=1000)
    most = placed.groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert placed.count() == 5000 and most < 500
    monkeypatch.setattr(m, "BUCKET_ROWS", 200)
    placed, _ = m.packed(df.withColumn("size", m.F.lit(0).cast("bigint")))
    most = placed.groupBy("bucket").count().agg({"count": "max"}).first()[0]
    assert placed.count() == 5000 and most < 600


def test_very_long_texts(spark, tmp_path):
    frame = docs(spark, [(1, "word " * 300_000), (2, "a b c"), (3, "word " * 200_000)], source=None)
    folder = saved(tmp_path, documents=frame)
    same_as_sql(m.op8_mix_sources(spark, folder), folder, sql.op8(), ["documents"])


def test_no_rows_and_no_words(spark):
    assert m.mixture(docs(spark, ["x"]).limit(0)).count() == 0
    assert rows(m.mixture(docs(spark, [None, ""])), "doc_id", "size", "taken", "target") == [(0, 0, 0, 0.0), (1, 0, 0, 0.0)]
