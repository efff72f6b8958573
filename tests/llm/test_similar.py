import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from test_simhash import ASCII
from util import docs, rows

from recollect.llm import similar, simhash


def shingle_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {" ".join(words[k : k + width]) for k in range(len(words) - width + 1)} if len(words) >= width else {" ".join(words)} if words else set()


def brute_similar(ids, texts, similarity=0.8):
    """The least id that links of all pairs with the similarity reach, for each id."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(ids)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(i, least.get(find(k), i))
    return [least[find(k)] for k in range(len(ids))]


def corpus(seed, groups=25):
    rng = random.Random(seed)
    texts = ["", None, " \t", "one", "ONE", "two words", "four short words here", "four short words there"]
    for _ in range(groups):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([8, 40, 150, 400]))]
        for _ in range(rng.choice([1, 2, 6])):
            other = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                other[rng.randrange(len(other))] = f"x{rng.randint(0, 3000)}"
            texts.append(rng.choice([str, str.upper])(" ".join(other[rng.choice([0, 0, 1]) :])))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [simhash.BLOCK, 3])
def test_components_are_those_of_all_pairs(spark, block):
    texts = corpus(4, 25 if block > 3 else 8)
    frame = docs(spark, texts)
    for name in ("rep", "n", "f0", "trie", "component_id", "row", "row_more", "group", "set", "side"):
        frame = frame.withColumn(name, similar.F.lit("clash"))
    got = {r.doc_id: (r.component_id, r.kept) for r in similar.similar_documents(frame, block=block).collect()}
    want = brute_similar(list(range(len(texts))), texts)
    assert got == {k: (c, k == c) for k, c in enumerate(want)} and len(set(want)) < len(want)


def test_pairs_about_the_limit_are_compared_as_sets(spark):
    # All pairs of a base with a longer copy: 100 shingles of 104 + k, so 0.8 is passed at k = 25.
    base = [f"w{k}" for k in range(104)]
    frame = docs(spark, [(k + 1, " ".join([*base, *[f"t{k}x{j}" for j in range(k)]])) for k in (0, 20, 24, 25, 26, 30)])
    got = dict(rows(similar.similar_documents(frame), "doc_id", "component_id"))
    assert got == {1: 1, 21: 1, 25: 1, 26: 1, 27: 27, 31: 31}


def test_no_link_without_a_comparison_of_sets(spark):
    # 7 of 9 shingles: below 0.8, but about one such pair in 70 has fingerprints nearer than most links.
    pairs = [[" ".join([*(f"p{k}w{j}" for j in range(11)), last]) for last in ("one", "other")] for k in range(700)]
    frame = docs(spark, [text for pair in pairs for text in pair])
    assert similar.similar_documents(frame).where("not kept").count() == 0


def classes_of(frame):
    own = similar.shingled(frame.select("doc_id", "text"), 5).select("doc_id", similar.F.pandas_udf(similar.wide_majority, "f0 bigint, f1 bigint, f2 bigint, f3 bigint, n int")("hashes").alias("f"))
    return own.select("f.*", similar.F.col("doc_id").alias("rep"))


@pytest.mark.parametrize("most", [similar.MEMBERS, 16])
def test_a_large_group_returns_forests_and_not_its_pairs(spark, most):
    base = [f"w{k}" for k in range(500)]
    texts = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(0, 500, 2)]
    # Members of the group of candidates that link with nothing: a fifth of their words is their own.
    texts += [" ".join([*base[:400], *(f"own{k}x{j}" for j in range(100))]) for k in range(40)]
    texts.append(" ".join([*base[:400], *(f"own{3}x{j}" for j in range(90)), *"abcdefghij"]))
    frame = docs(spark, texts)
    got = dict(rows(similar.similar_documents(frame, most=most), "doc_id", "component_id"))
    assert [got[k] for k in range(len(texts))] == brute_similar(list(range(len(texts))), texts)
    assert similar.candidate_links(classes_of(frame), 0.8).count() < 16 * 10 * len(texts)


def test_long_segments_find_the_same_groups(spark, monkeypatch):
    texts = corpus(6, 12)
    short = set(rows(similar.similar_documents(docs(spark, texts)), "doc_id", "component_id"))
    monkeypatch.setattr(similar, "segments", lambda total: (24, 2, 8))
    assert set(rows(similar.similar_documents(docs(spark, texts)), "doc_id", "component_id")) == short
    monkeypatch.undo()
    assert similar.segments(1 << 21) == (16, 1, 16) and similar.segments((1 << 21) + 1) == (24, 2, 8)


def test_segments_are_the_same_for_any_number_of_documents(spark, monkeypatch):
    asked, before = [], similar.segments
    monkeypatch.setattr(similar, "segments", lambda total: asked.append(total) or before(total))
    for texts in (["one text"], corpus(1, 3)):
        similar.candidate_links(classes_of(docs(spark, texts)), 0.8)
    assert len(asked) == 2 and asked[0] == asked[1]


def test_a_group_of_near_copies_gives_few_edges_a_member(spark):
    base = [f"w{k}" for k in range(500)]
    texts = [" ".join([*base[:k], f"changed{k}", *base[k + 1 :]]) for k in range(0, 500, 2)]
    assert similar.candidate_links(classes_of(docs(spark, texts)), 0.8).distinct().count() < 8 * len(texts)


def test_shared_sizes_and_links_against_sets(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [rng.choice(60, rng.integers(0, 40), replace=False) for _ in range(30)]
    left = np.array([2, 5, 9, 29])
    for columns in (7, similar.COLUMNS):
        monkeypatch.setattr(similar, "COLUMNS", columns)
        assert (similar.shared_sizes(sets, left) == [[len(set(sets[a]) & set(s)) for s in sets] for a in left]).all()
    assert similar.shared_sizes([np.empty(0, int)] * 2, np.array([0])).tolist() == [[0, 0]]
    frame = pd.DataFrame({"rep": [5, 6, 7, 8], "root": [5, 6, 6, 8], "side": [0, 0, 1, 1], "n": [5, 5, 4, 4], "set": [np.arange(5), np.arange(50, 55), np.arange(50, 54), np.arange(4)]})
    assert similar.linked(frame, 0.8, True).to_numpy().tolist() == [[8, 5]]


def near_pairs(texts, similarity=0.8):
    """All pairs of different sets with the similarity, and copies: sets are met by their rarest shingles."""
    sets = [frozenset(shingle_set(t)) for t in texts]
    one = {s: k for k, s in reversed(list(enumerate(sets)))}
    df = Counter(h for s in one for h in s)
    seen, found = {}, []
    for s, k in one.items():
        ordered = sorted(s, key=lambda h: (df[h], h))
        prefix = ordered[: len(s) - -(-len(s) * 4 // 5) + 1]
        for j in {j for h in prefix for j in seen.get(h, ())}:
            if len(s & sets[j]) >= similarity * len(s | sets[j]):
                found.append((j, k))
        for h in prefix:
            seen.setdefault(h, []).append(k)
    return found, [(one[s], k) for k, s in enumerate(sets) if one[s] != k]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="needs the tables")
def test_recall_over_the_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    ids = list(texts)
    got = dict(rows(similar.similar_documents(frame), "doc_id", "component_id"))
    pairs, copies = near_pairs(list(texts.values()))
    met = sum(got[ids[a]] == got[ids[b]] for a, b in pairs)
    want = brute_components(ids, pairs + copies)
    assert len(pairs) > 30 and met >= 0.95 * len(pairs)
    # No component holds more than all pairs reach.
    assert all(want[i] == want[c] for i, c in got.items())
    print(f"{met} of {len(pairs)} pairs met")


def brute_components(ids, pairs):
    root = {i: i for i in ids}
    find = lambda k: k if root[k] == k else find(root[k])
    for a, b in pairs:
        root[find(ids[a])] = find(ids[b])
    return {i: find(i) for i in ids}


def test_recall_of_short_texts_at_the_limit(spark):
    # Texts of n shingles and copies with as many words appended as the limit allows.
    sizes, count = (4, 5, 8, 12, 16, 20), 300
    pairs = [([f"p{n}x{k}w{j}" for j in range(n + 4)], [f"p{n}x{k}m{j}" for j in range(n // 4)]) for n in sizes for k in range(count)]
    frame = docs(spark, [text for base, tail in pairs for text in (" ".join(base), " ".join(base + tail))])
    gone = Counter(i // (2 * count) for (i,) in rows(similar.similar_documents(frame).where("not kept"), "doc_id"))
    assert [gone[k] >= 0.96 * count for k in range(len(sizes))] == [True] * len(sizes)
    print({n: gone[k] / count for k, n in enumerate(sizes)})


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    near = text.replace("w29", "changed")
    df = docs(spark, [(7, text), (7, text), (9, near), (None, text), (None, "lonely words are here"), (7, "another text of the same id")])
    found = similar.similar_documents(df)
    assert rows(found, "doc_id", "component_id", "kept") == [(7, 7, True), (7, 7, True), (7, 7, True), (9, 7, False), (None, 7, False), (None, None, True)]
    assert len({tuple(r) for r in found.where("doc_id = 7").select("row", "row_more").collect()}) == 2
    assert similar.similar_documents(df.limit(0)).count() == 0
    left = similar.distinct_documents(df.withColumn("whole", similar.F.lit(1)).withColumn("row", similar.F.create_map(similar.F.lit("k"), "lang")))
    assert left.columns == [*df.columns, "whole", "row"] and sorted(map(str, (r.text for r in left.collect()))) == sorted([text, "lonely words are here", "another text of the same id"])


def test_limits_and_cut_node_pairs():
    far, short = similar.limits(0.8)
    assert 50 < far < short < 75 and similar.limits(1.0) == (0, 0)
    a0, a1, b0, b1 = simhash._cut(np.array([0, 5]), np.array([4, 1_000_005]), np.array([0, 7]), np.array([3, 100_007]))
    assert ((a1 - a0) * (b1 - b0) <= simhash.CHUNK_PAIRS).all() and (a1 - a0).sum() == 1_000_004 and (a1[1:-1] == a0[2:]).all()
