import hashlib
from collections import Counter
from functools import cache

import pytest
from pyspark.sql import functions as F
from util import docs

from recollect.llm import alignment as m


@pytest.fixture(scope="module")
def plain():
    """The two libraries' own tokenizers, and the bytes of their ids."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(m.BYTE_LEVEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=m.PIECES)


LETTERS = m.byte_letters()


@cache
def token_bytes(plain, side, i):
    if side == 0:
        return bytes(LETTERS[c] for c in plain[0].id_to_token(i))
    piece = plain[1].id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") and len(piece) == 6 else piece.replace("▁", " ").encode()


def brute(plain, texts):
    """What the contract says, token by token."""
    found = []
    for t in texts:
        want = (" " + (t or "")).encode()
        a = plain[0].encode(" " + t, add_special_tokens=False).ids if t else []
        b = plain[1].encode(t) if t else []
        bytes_a, bytes_b = [token_bytes(plain, 0, i) for i in a], [token_bytes(plain, 1, i) for i in b]
        if not t or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            found.append([])
            continue
        groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a <= at_b and i < len(a):
                groups[-1][0].append(a[i])
                at_a += len(bytes_a[i])
                i += 1
            else:
                groups[-1][1].append(b[j])
                at_b += len(bytes_b[j])
                j += 1
            if at_a == at_b and groups[-1][1]:
                groups.append(([], []))
        assert groups.pop() == ([], [])
        found.append(groups)
    pairs = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in found]
    held = Counter(p for own in pairs for p in own)
    best = {}
    for (x, _), n in held.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, own in zip(found, pairs, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append(
            (
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                sum(own.values()),
                sum(n for p, n in own.items() if held[p] == best[p[0]]),
                sum(n * held[p] for p, n in own.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return out


TEXTS = [
    "Thheouble heenwh on reti ingeser erster that.",
    "Thheouble heenwh on reti ingeser erster that.",
    None,
    "",
    " ",
    "  two  spaces, then\ttab\nand lines\n\n\nend  ",
    "naïve café — “quotes” … 你好，世界 🙂🙂 🏳️‍🌈 ﬁligature ½ Å Å",
    "<|endoftext|> <s> </s> <unk> <0x41> [INST]",
    "▁ a mark of spaces",
    "x\u0000y​z﻿",
    "don't can't I'll we've 12345 3.14159 1,000,000",
    "a" * 5000,
    "ab " * 4000,
    "é" * 300 + "́" * 200,
    "    " * 500,
    "{}[]();:\\/*&^%$#@!~`" * 20,
    "Nicht aulich für sch erüver enau sch der. Straße ÄÖÜ",
]


def test_same_as_token_by_token(spark, plain):
    want = brute(plain, TEXTS)
    frame = docs(spark, TEXTS).withColumn("row", F.lit(1)).withColumn("a", F.lit("x")).withColumn("part", F.lit(None).cast("string"))
    found = {r.doc_id: tuple(r)[1:] for r in m.alignment(frame).collect()}
    assert [found[k] for k in range(len(TEXTS))] == want
    assert sum(w[2] > 0 for w in want) >= 10 and want[2] == (0, 0, 0, 0, 0, 0, "")


def test_given_documents(spark, plain):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute(plain, [r.text for r in rows]), strict=True))
    found = {r.doc_id: tuple(r)[1:] for r in m.op13_token_alignment(spark, "/root/testdata/sf0.001").collect()}
    assert found == want


def test_small_batches_and_wide_groups_change_nothing(spark, monkeypatch):
    frame = docs(spark, TEXTS)
    want = sorted(map(tuple, m.alignment(frame).collect()), key=str)
    monkeypatch.setattr(m, "HELD", 64)
    monkeypatch.setattr(m, "WIDE", 1)
    monkeypatch.setattr(m, "BROADCAST_PAIRS", 0)
    assert sorted(map(tuple, m.alignment(frame.repartition(3)).collect()), key=str) == want


def test_links_of_one_wide_group(monkeypatch):
    """Nothing but the end is shared: all pairs of tokens, counted by distinct ids."""
    monkeypatch.setattr(m, "WIDE", 10)
    widths = (m.np.array([2, 2, 1]), m.np.array([3, 3, 1]))
    ids = lambda *of: [m.np.array(x, dtype=m.np.int64) for x in of]
    g = m.merged(ids([0, 1, 0, 1, 2], [], [2]), ids([0, 1, 0], [], [2]), widths)
    assert g.sizes_a.tolist() == [3, 2, 1] and g.sizes_b.tolist() == [2, 1, 1] and g.doc.tolist() == [0, 0, 2]
    got = {tuple(map(int, x[:3])): int(x[3]) for x in zip(*m.links(g), strict=True)}
    by_hand = Counter((int(g.doc[x]), int(a), int(b)) for a, x in zip(g.a, g.group_a, strict=True) for b, y in zip(g.b, g.group_b, strict=True) if x == y)
    assert got == by_hand


def test_rows_that_share_an_id_and_no_rows(spark):
    frame = docs(spark, [(1, "one text here"), (1, "one text here"), (1, "another"), (None, "one text here")])
    found = m.alignment(frame).collect()
    assert sorted(map(str, (r.doc_id for r in found))) == ["1", "1", "1", "None"]
    same = [r for r in found if r.n_a == found[0].n_a and r.groups_sha256 == found[0].groups_sha256]
    assert len({(r.n_links, r.n_best, r.count_sum) for r in same}) == 1
    assert m.alignment(frame.limit(0)).count() == 0


def test_a_very_long_text(spark, plain):
    long = "Straße heenwh, 12 " * 8_000
    (want,) = brute(plain, [long])
    (r,) = m.alignment(docs(spark, [long])).collect()
    assert tuple(r)[1:] == want
