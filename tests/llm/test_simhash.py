import random

import numpy as np
import pytest
import xxhash
from util import docs, rows

from recollect.llm import common, simhash

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    runs = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(ids, prints, budget=2):
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= budget:
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    texts = ["", None, "one", "One", "two words", "  \t\n", "Ä Öl über", "a\x0bb\x0cc\rd"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 200]))]
        texts += [" ".join(base), " ".join(base).upper(), " ".join([*base[:-1], "changed"])]
    texts.append(" ".join(rng.choice(words) for _ in range(70_000)))  # longer than a chunk
    found = simhash.near_duplicates(docs(spark, texts).withColumn("fp", common.F.lit("clash")).withColumn("root", common.F.lit(1)))
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), prints)
    got = {r.doc_id: (r.fingerprint, r.component_id, r.kept) for r in found.collect()}
    assert got == {k: (f"{p:016x}", c, k == c) for k, (p, c) in enumerate(zip(prints, want, strict=True))}


@pytest.mark.parametrize("within", [True, False])
def test_trie_pairs_are_all_pairs_within_the_budget(within):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64)
    values = np.unique(np.bitwise_xor.reduce(np.concatenate([rng.choice(centre, 400)[:, None], flips], 1), axis=1))
    other = values if within else np.unique(values[::3] ^ np.uint64(4))
    got = sorted((int(a), int(b)) for i, j in simhash.trie_pairs(values, other, 2, within) for a, b in zip(i, j, strict=True))
    want = sorted((a, b) for a in range(len(values)) for b in range(len(other)) if (not within or a < b) and (int(values[a]) ^ int(other[b])).bit_count() <= 2)
    assert got == want and want


def test_trie_pairs_in_small_parts(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_PAIRS", 7)
    test_trie_pairs_are_all_pairs_within_the_budget(True)


def test_crowded_cells_are_dealt_into_blocks(spark):
    values = [(1 << 40) + (1 << k) for k in range(30)] + [-5, -6, -7 - (1 << 20)]
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = common.components(simhash.near_fingerprint_links(df, 2, block=4))
    roots = dict(rows(found, "node", "root"))
    mask = (1 << 64) - 1
    want = brute_components(list(range(len(values))), [v & mask for v in values])
    groups = lambda xs: sorted(map(sorted, xs))
    by = {}
    for v, c in zip(values, want, strict=True):
        by.setdefault(c, []).append(v)
    got = {}
    for v in values:
        got.setdefault(roots.get(v, v), []).append(v)
    assert groups(by.values()) == groups(got.values())


def test_repeated_rows_null_ids_and_no_rows(spark):
    df = docs(spark, [(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "lonely words are here")])
    assert rows(simhash.near_duplicates(df), "doc_id", "component_id", "kept") == [(7, 7, True), (7, 7, True), (None, 7, False), (None, None, True)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain_a_star_and_nothing(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 120)] + [(5, 5)]
    found = dict(rows(common.components(spark.createDataFrame(edges, "a bigint, b bigint")), "node", "root"))
    assert found == {k: 0 for k in range(21)} | {k: 100 for k in range(100, 120)}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_forest_matches_its_edges():
    forest = common.Forest(6)
    forest.add(np.array([5, 4]), np.array([4, 3]))
    forest.add(np.array([0]), np.array([1]))
    assert forest.root.tolist() == [0, 0, 2, 3, 3, 3]
    assert sorted(zip(*map(list, forest.edges()), strict=True)) == [(1, 0), (4, 3), (5, 3)]
