"""Token counts by greedy longest match, in one pass over a failure-link automaton."""

from __future__ import annotations

import base64
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import read

#: A vocabulary in the format of base64 token and rank on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level vocabularies of this kind cut a text into words (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose counts a Python worker remembers, and their longest length.
REMEMBERED, LONGEST = 1 << 18, 64


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    return [base64.b64decode(line.split()[0]) for line in Path(path).read_bytes().splitlines() if line.strip()]


class Automaton:
    """Greedy longest-match piece counts in time linear in the word.

    A trie of the vocabulary. Where a byte has no edge, the failure link leads to the node of
    what is left after the longest piece is taken, and popped says how many pieces that took;
    so no byte is read twice and no piece is built.
    """

    def __init__(self, pieces: list[bytes]):
        self.edge: dict[int, int] = {}
        ends, parents, letters = [False], [0], [0]
        for piece in pieces:
            at = 0
            for c in piece:
                at_next = self.edge.get(at << 8 | c)
                if at_next is None:
                    at_next = self.edge[at << 8 | c] = len(ends)
                    ends.append(False)
                    parents.append(at)
                    letters.append(c)
                at = at_next
            ends[at] = at > 0
        depth = [0] * len(ends)
        for v in range(1, len(ends)):
            depth[v] = depth[parents[v]] + 1
        self.fail: list[int] = [-1] * len(ends)
        self.popped = [0] * len(ends)
        for v in sorted(range(1, len(ends)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            u, c = parents[v], letters[v]
            z, n = self.fail[u], self.popped[u]
            while z >= 0 and z << 8 | c not in self.edge:
                n += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.edge[z << 8 | c], n

    def count(self, word: bytes) -> int:
        """Pieces of the word; 1, an unknown token, where greedy matching gets stuck."""
        edge, fail, popped = self.edge, self.fail, self.popped
        at = n = 0
        for c in word:
            while (to := edge.get(at << 8 | c)) is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
            at = to
        while at:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


_BUILT: dict[int, tuple[Automaton, dict[str, int]]] = {}


def counted(docs: DataFrame, path: str = VOCABULARY, pattern: str = WORDS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row of the documents.

    The text is cut into words by ``pattern`` and each word's pieces are counted. Null and empty
    texts count 0. Rows with equal ids are counted each. Extra columns are ignored. The driver
    reads the vocabulary and sends it to the executors, which need no file.
    """
    pieces = vocabulary(path)
    sent = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash((path, len(pieces), pattern))

    @F.pandas_udf("n_words bigint, n_tokens bigint")
    def count(texts: pd.Series) -> pd.DataFrame:
        if key not in _BUILT:
            _BUILT[key] = (Automaton(sent.value), {})
        automaton, known = _BUILT[key]
        cut = regex.compile(pattern).findall
        rows = []
        for t in texts:
            words = cut(t) if t else ()
            n = 0
            for w in words:
                k = known.get(w)
                if k is None:
                    k = automaton.count(w.encode("utf-8", "surrogatepass"))
                    if len(w) <= LONGEST:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known[w] = k
                n += k
            rows.append((len(words), n))
        return pd.DataFrame(rows, columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), count(F.col(text)).alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words and tokens, as ``counted`` finds them."""
    return counted(read(spark, sf_dir, "documents"))
