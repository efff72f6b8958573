import random

import regex
from util import docs, rows

from recollect.llm import token_counts as tc


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pieces), 0)
        if not size:
            return 1
        n, at = n + 1, at + size
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(0)
    for trial in range(60):
        letters = b"abc"[: 2 + trial % 2]
        pieces = {bytes(rng.choice(letters) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = tc.Automaton(sorted(pieces, key=lambda _: rng.random()))
        for _ in range(60):
            word = bytes(rng.choice(letters) for _ in range(rng.randint(0, 14)))
            assert automaton.count(word) == greedy(word, pieces), (pieces, word)


def test_known_case():
    automaton = tc.Automaton([b"a", b"abcdx", b"b", b"c", b"cdy", b"dz"])
    assert automaton.count(b"abcdz") == 4 and automaton.count(b"abcdx") == 1 and automaton.count(b"abcdq") == 1 and automaton.count(b"") == 0


def test_counts_match_greedy_with_a_real_vocabulary(spark):
    pieces = set(tc.vocabulary())
    texts = ["Hello world, it's  naïve!\n\n", None, "", "   ", "漢字 🙂🙂", "a" * 3000, "x1234 don't\t", "same", "same", "\u0301\u200b"]
    found = rows(tc.counted(docs(spark, texts).selectExpr("*", "1 as n_words", "2 as c")), "doc_id", "n_words", "n_tokens")
    for k, words, n in found:
        cut = regex.findall(tc.WORDS, texts[k] or "")
        assert words == len(cut) and n == sum(greedy(w.encode(), pieces) for w in cut) and "".join(cut) == (texts[k] or "")
    assert len(found) == len(texts) and tc.counted(docs(spark, ["x"]).limit(0)).count() == 0
