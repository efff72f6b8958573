"""Alignment of two tokenizers over the same bytes, by a merge of their tokens' ends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import read, table_copy

#: A byte-level vocabulary (A) and a piece model (B); each is one of several files of a folder.
BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level vocabularies of this kind cut a text into words (fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose tokens are in a task's memory at once; a longer text is taken alone.
HELD = 2 << 20
#: Up to this many id pairs (some 64 MB) with their counts are broadcast to the links.
BROADCAST_PAIRS = 2_000_000
#: A group with more token pairs than this is counted by distinct ids.
WIDE = 4096

ROWS = "part int, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, a int, b int, rows array<bigint>, times array<int>"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves; the others take the letters from 256 on, in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Tokenizers:
    """Both vocabularies, as the contents of their files; a task builds from them what encodes."""

    byte_level: str
    pieces: bytes

    @cached_property
    def a_bytes(self) -> dict[int, bytes]:
        """Special tokens are left out: their strings inside a text are plain text."""
        spec, letters = json.loads(self.byte_level), byte_letters()
        special = {t["id"] for t in spec.get("added_tokens", [])}
        return {i: bytes(letters[c] for c in token) for token, i in spec["model"]["vocab"].items() if i not in special}

    @cached_property
    def a(self) -> tiktoken.Encoding:
        """Ids of such a vocabulary are in the order of its merges, so they are ranks."""
        return tiktoken.Encoding("byte_level", pat_str=WORDS, mergeable_ranks={b: i for i, b in self.a_bytes.items()}, special_tokens={})

    @cached_property
    def b(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.pieces)

    @cached_property
    def b_bytes(self) -> list[bytes]:
        """A piece in UTF-8 with U+2581 as space; <0xHH> is the byte HH."""
        found = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        return [bytes([int(p[3:5], 16)]) if regex.fullmatch(r"<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in found]

    @cached_property
    def widths(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of each id of A and of B."""
        a = np.zeros(1 + max(self.a_bytes, default=0), np.int64)
        a[list(self.a_bytes)] = [len(b) for b in self.a_bytes.values()]
        return a, np.array([len(b) for b in self.b_bytes], np.int64)

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """(characters, lengths) of each id in decimal, after a place for the sign before it."""
        written = [f" {i}".encode() for i in range(max(len(self.widths[0]), len(self.widths[1])))]
        wide = np.array(written)
        return wide.view(np.uint8).reshape(len(written), wide.dtype.itemsize), np.array([len(w) for w in written])


def loaded(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Tokenizers:
    return Tokenizers(Path(byte_level).read_text(encoding="utf-8"), Path(pieces).read_bytes())


def encoded(both: Tokenizers, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Both tokenizers' ids of space and text; none if there is no text, or either's bytes differ from it."""
    none = np.zeros(0, np.int64)
    if not text:
        return none, none
    want = b" " + text.encode("utf-8", "surrogatepass")
    b = both.b.encode(text)
    if b"".join(map(both.b_bytes.__getitem__, b)) != want:
        return none, none
    a = both.a.encode_to_numpy(" " + text, disallowed_special=())
    return (a.astype(np.int64), np.array(b, np.int64)) if both.a.decode_bytes(a) == want else (none, none)


def runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, 2... within each run of so many."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


@dataclass
class Groups:
    """The tokens of some texts one after another, cut wherever a token of A and one of B both end."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    sizes_a: np.ndarray
    sizes_b: np.ndarray
    doc: np.ndarray  # of each group


def merged(a_ids: list[np.ndarray], b_ids: list[np.ndarray], widths: tuple[np.ndarray, np.ndarray]) -> Groups:
    """Merges the cumulative ends of both sides, as two pointers over them would.

    Both lists of ends rise, so a stable sort of one after the other is one merge of two runs; ends
    that meet in it are the cuts. Both sides of a text have the same number of bytes, so texts can
    stand one after another: each ends in a cut.
    """
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate(none + a_ids), np.concatenate(none + b_ids)
    both = np.concatenate([np.cumsum(widths[0][a]), np.cumsum(widths[1][b])])
    order = np.argsort(both, kind="stable")
    ranked = both[order]
    met = np.flatnonzero(ranked[1:] == ranked[:-1])
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[order[met]] = 1
    last_b[order[met + 1] - len(a)] = 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    doc = np.repeat(np.arange(len(a_ids)), [len(ids) for ids in a_ids])[last_a > 0]
    return Groups(a, b, group_a, group_b, np.bincount(group_a, minlength=len(met)), np.bincount(group_b, minlength=len(met)), doc)


def links(g: Groups) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, a, b, times): how often each id of A shares a group with each id of B, by text.

    In a group of very many tokens the pairs of ids are counted by multiplying, so that memory
    follows the distinct ids, not the pairs of tokens.
    """
    wide = g.sizes_a * g.sizes_b > WIDE
    first_a, first_b = np.cumsum(g.sizes_a) - g.sizes_a, np.cumsum(g.sizes_b) - g.sizes_b
    at = np.flatnonzero(~wide[g.group_a]) if wide.any() else np.arange(len(g.a))
    many = g.sizes_b[g.group_a[at]]
    left = np.repeat(at, many)
    right = np.repeat(first_b[g.group_a[at]], many) + runs(many)
    # By pair first, then by text: equal pairs of several texts stand together.
    packed = lambda a, b, doc: (a << 20 | b) << 22 | doc
    key = np.sort(packed(g.a[left], g.b[right], g.doc[g.group_a[left]]))
    start = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(start, append=len(key))
    key = key[start]
    if wide.any():
        keys, counts = [key], [times]
        for k in np.flatnonzero(wide):
            a, n = np.unique(g.a[first_a[k] : first_a[k] + g.sizes_a[k]], return_counts=True)
            b, m = np.unique(g.b[first_b[k] : first_b[k] + g.sizes_b[k]], return_counts=True)
            keys.append(packed(np.repeat(a, len(b)), np.tile(b, len(a)), g.doc[k]))
            counts.append(np.outer(n, m).ravel())
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        times = np.zeros(len(key), np.int64)
        np.add.at(times, at, np.concatenate(counts))
    return key & (1 << 22) - 1, key >> 42, key >> 22 & (1 << 20) - 1, times


def digests(g: Groups, n: int, digits: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each of n texts; an empty string for one without tokens.

    The tokens are laid out in the order in which they are written: of a group A's, then B's. Each
    is a row of characters, the sign before it and its digits, and the rows' used parts are the text.
    """
    chars, lengths = digits
    spot_a = np.arange(len(g.a)) + (np.cumsum(g.sizes_b) - g.sizes_b)[g.group_a]
    spot_b = np.arange(len(g.b)) + np.cumsum(g.sizes_a)[g.group_b]
    ids = np.empty(len(g.a) + len(g.b), np.int64)
    ids[spot_a], ids[spot_b] = g.a, g.b
    sign = np.full(len(ids), ord(","), np.uint8)
    sign[spot_a[np.diff(g.group_a, prepend=-1) > 0]] = ord(";")
    sign[spot_b[np.diff(g.group_b, prepend=-1) > 0]] = ord("|")
    rows = chars[ids]
    rows[:, 0] = sign
    text = rows[np.arange(rows.shape[1]) < lengths[ids][:, None]].tobytes()
    tokens = np.bincount(g.doc, weights=g.sizes_a + g.sizes_b, minlength=n).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths[ids])])[np.concatenate([[0], np.cumsum(tokens)])]
    view = memoryview(text)
    return [hashlib.sha256(view[lo + 1 : hi]).hexdigest() if hi > lo else "" for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def aligned(docs: DataFrame, both: Tokenizers | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows ROWS: those with part 0 are documents with their counts and digest, those with part 1 links.

    A row of links has an id pair, and the rows of documents that hold it linked with the number of their
    links. Tasks hold some HELD bytes of text at once, and a link's row is one for each such batch, so
    a pair that is in all documents is in many rows of bounded size. ``row`` numbers the documents;
    rows with equal or null ids are documents of their own.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens.
    A long text is encoded whole. Extra columns are ignored, whatever their names; no rows give none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(both or loaded())

    def emitted(ids: list, a_ids: list, b_ids: list, first: int) -> pd.DataFrame:
        tools = sent.value
        n = len(ids)
        g = merged(a_ids, b_ids, tools.widths)
        doc, a, b, times = links(g)
        count = lambda where, weights=None: np.bincount(where, weights=weights, minlength=n).astype(np.int64)
        start = np.flatnonzero(np.diff(a << 20 | b, prepend=-1))
        nulls = lambda k, kind="Int64": pd.array([None] * k, dtype=kind)
        two = lambda x, y: pd.concat([pd.Series(x), pd.Series(y)], ignore_index=True)
        counts = {"row": np.arange(first, first + n), "n_a": [len(x) for x in a_ids], "n_b": [len(x) for x in b_ids], "n_groups": count(g.doc), "n_links": count(g.doc, g.sizes_a * g.sizes_b)}
        whole = {c: two(pd.array(v, dtype="Int64"), nulls(len(start))) for c, v in counts.items()}
        runs_of = lambda v: [None] * n + (np.split(v, start[1:]) if len(start) else [])
        made = {
            "part": two(np.zeros(n, np.int32), np.ones(len(start), np.int32)),
            "doc_id": two(pd.array(ids, dtype="Int64"), nulls(len(start))),
            **whole,
            "groups_sha256": pd.Series(digests(g, n, tools.digits) + [None] * len(start), dtype=object),
            "a": two(nulls(n, "Int32"), pd.array(a[start], dtype="Int32")),
            "b": two(nulls(n, "Int32"), pd.array(b[start], dtype="Int32")),
            "rows": pd.Series(runs_of(doc + first), dtype=object),
            "times": pd.Series(runs_of(times.astype(np.int32)), dtype=object),
        }
        return pd.DataFrame({c: made[c] for c in (x.split()[0] for x in ROWS.split(", "))})

    def align(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = sent.value
        first = TaskContext.get().partitionId() << 36
        ids, a_ids, b_ids, held = [], [], [], 0
        for part in parts:
            for i, t in zip(part["doc_id"].array, part["text"], strict=True):
                a, b = encoded(tools, t)
                ids.append(None if pd.isna(i) else int(i))
                a_ids.append(a)
                b_ids.append(b)
                held += len(t or "")
                if held >= HELD or len(ids) == 1 << 16:
                    yield emitted(ids, a_ids, b_ids, first)
                    first += len(ids)
                    ids, a_ids, b_ids, held = [], [], [], 0
        if ids:
            yield emitted(ids, a_ids, b_ids, first)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInPandas(align, ROWS)


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, documents, best) of rows of ``aligned``: how many documents hold an id pair linked, and whether that is its A id's highest."""
    counts = found.where("part = 1").groupBy("a", "b").agg(F.sum(F.size("rows")).cast("bigint").alias("documents"))
    highest = counts.groupBy("a").agg(F.max("documents").alias("highest"))
    return counts.join(highest, "a").select("a", "b", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def alignment(docs: DataFrame, both: Tokenizers | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of the documents.

    As ``aligned`` says, with each document's links joined to their id pairs' counts over the corpus: n_best
    links have the highest count of their A id, ties included; count_sum is the sum over links. The
    pairs are counted, and broadcast up to BROADCAST_PAIRS. Beyond, links are shuffled to them: a
    pair in very many documents has a row for each batch of texts, among which that join can be split.
    """
    found = table_copy(aligned(docs, both, id_col, text), "aligned")
    pairs = found.where("part = 1").select("a", "b", "rows", "times")
    counts = table_copy(pair_counts(found), "pairs")
    # Where the counts are sent to the links, a document's links are summed where they stand.
    met = pairs.join(F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts.hint("merge"), ["a", "b"])
    each = met.select("documents", "best", F.inline(F.arrays_zip("rows", "times"))).groupBy("rows").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("bigint").alias("n_best"),
        F.sum(F.col("times") * F.col("documents")).cast("bigint").alias("count_sum"),
    )
    own = found.where("part = 0").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = own.join(each.withColumnRenamed("rows", "row"), "row", "left")
    zero = F.lit(0).cast("bigint")
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's alignment, as ``alignment`` finds it."""
    return alignment(read(spark, sf_dir, "documents"))
