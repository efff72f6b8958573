"""Language identification: each document as a mixture of languages, fitted by EM."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import held_out, read, sampled, whole_rows

#: Buckets that n-grams are hashed to, and characters of an n-gram.
BUCKETS, ORDER = 1 << 15, 3
#: Documents that the n-gram counts are learned from: all, or about so many by a hash of the row;
#: languages that are learned: all, or those with the most documents, ties by name.
FIT_ROWS, FIT_LANGS = 30_000, 256
SMOOTHING, ROUNDS = 0.5, 12
#: What a further language must add to the log-likelihood, in units of log(n-grams) / 2.
PENALTY = 2.0
#: Documents that the pipeline keeps have at least this share of one language.
LEAST_SHARE = 0.4

_LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])
_LETTERS[0xD800:0xE000] = False


@dataclass(frozen=True)
class Model:
    langs: list[str]
    likelihood: np.ndarray  # bucket x language


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(buckets, counts, any letter) of the n-grams of a text's words, padded by single spaces."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _LETTERS[np.minimum(codes, 0xFFFF)]
    for at in np.flatnonzero(codes > 0xFFFF):
        letters[at] = chr(codes[at]).isalpha()
    if not letters.any():
        return np.empty(0, np.int64), np.empty(0), False
    codes = np.concatenate([[32], np.where(letters, codes, 32), [32]]).astype(np.uint32)
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA6B) + codes[2:] * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    counts = np.bincount((h * np.uint32(0x27D4EB2F)) >> np.uint32(17), minlength=BUCKETS)
    some = np.flatnonzero(counts)
    return some, counts[some].astype(float), True


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The n-gram likelihoods of each value of ``lang``, from rows with ``text`` and ``lang``.

    Rows with a null text or lang are left out. About ``fit_rows`` rows at most are taken, by a
    hash of all their columns, and FIT_LANGS languages. Counts are summed by Spark; one row for
    each language and bucket, BUCKETS for each language at most, comes to the driver.
    """
    rows = rows.where("text is not null and lang is not null")
    langs = F.broadcast(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(FIT_LANGS).select("lang"))
    rows = sampled(rows, fit_rows).select("text", "lang").join(langs, "lang")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for part in parts:
            for text, lang in zip(part["text"], part["lang"], strict=True):
                buckets, counts, _ = gram_counts(text)
                sums.setdefault(lang, np.zeros(BUCKETS))[buckets] += counts
        for lang, total in sums.items():
            some = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": some, "n": total[some]})

    table = rows.mapInPandas(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    seen = np.zeros((BUCKETS, len(langs)))
    seen[table["bucket"], table["lang"].map({x: k for k, x in enumerate(langs)}).astype(int)] = table["n"]
    return Model(langs, (seen + SMOOTHING) / (seen.sum(0) + SMOOTHING * BUCKETS))


def _em(p: np.ndarray, counts: np.ndarray, total: float, rounds: int) -> tuple[np.ndarray, float]:
    """(proportions, log-likelihood) of the mixture of the columns of p."""
    share = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(rounds):
        share = share * ((counts / (p @ share)) @ p) / total
    return share, float(counts @ np.log(p @ share))


def mixture(model: Model, text: str | None, rounds: int = ROUNDS, penalty: float = PENALTY) -> dict[str, float]:
    """The proportions of the selected languages, the largest first; empty without a letter.

    The proportions of all languages are fitted first. The set starts with the language that
    explains the text best alone; the next one by proportion joins as long as the likelihood
    rises by more than the penalty. Ties go to the first language by name.
    """
    if text is None or not model.langs:
        return {}
    buckets, counts, any_letter = gram_counts(text)
    if not any_letter:
        return {}
    p, total = model.likelihood[buckets], counts.sum()
    every, most = _em(p, counts, total, rounds)
    alone = counts @ np.log(p)
    chosen = [int(np.argmax(alone))]
    share, best = np.ones(1), float(alone[chosen[0]])
    price = penalty * np.log(total + 1) / 2
    if most - best > price:
        for k in np.argsort(-every, kind="stable"):
            if k not in chosen:
                tried, value = _em(p[:, [*chosen, k]], counts, total, rounds)
                if value - best <= price:
                    break
                chosen, share, best = [*chosen, int(k)], tried, value
    order = sorted(range(len(chosen)), key=lambda k: (-share[k], chosen[k]))
    return {model.langs[chosen[k]]: float(min(1.0, max(0.0, share[k]))) for k in order}


def identified(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score", langs_out: str = "langs") -> DataFrame:
    """The rows with the predicted language, its proportion, and the selected languages, comma-joined.

    The proportion is that in the mixture of the selected languages: 1 where one is enough. Null
    texts and texts without a letter get ``und``, 0 and no languages. Whole texts are read,
    however long; equal texts get equal results, and ties go to the first language by name. Every
    row stays, repeated ones too; a column with the name of an output is replaced by it.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, langs string")
    def predict(texts: pd.Series) -> pd.DataFrame:
        found = [mixture(held.value, t) for t in texts]
        rows = [(*next(iter(x.items()), ("und", 0.0)), ",".join(x)) for x in found]
        return pd.DataFrame(rows, columns=["lang", "score", "langs"])

    outs = {lang_out: "lang", score_out: "score", langs_out: "langs"}
    rest = [F.col(f"doc.`{c}`") for c in docs.columns if c not in outs]
    return whole_rows(docs, predict(F.col(text)).alias("found")).select(*rest, *[F.col(f"found.{c}").alias(out) for out, c in outs.items()])


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"), 5, 0)).select("doc_id", "text", "lang")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, its share of the mixture and the mixture's languages, as ``identified`` finds them."""
    docs = read(spark, sf_dir, "documents")
    found = identified(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score", "langs")
