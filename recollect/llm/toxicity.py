"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import held_out, read, sampled

#: Buckets that terms are hashed to; prefixes of a word that are terms beside the word itself.
BUCKETS, PREFIXES = 1 << 18, (3, 5, 7)
#: Labelled rows that a fit takes: all, or about so many by a hash; buckets that it keeps.
FIT_ROWS, KEPT = 12_000, 4096
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 15, 64, 0.1, 1e-5, 5
#: A document is predicted toxic from this score on.
CUT = 0.3
#: Words whose terms a Python worker remembers.
REMEMBERED = 1 << 18

_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def terms(word: str) -> tuple[int, ...]:
    """The buckets of a word and its prefixes."""
    return tuple({zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in (f"{word}$", *(word[:k] for k in PREFIXES if k < len(word)))})


@dataclass(frozen=True)
class Model:
    """Score = sigmoid(bias + sum w x + sum over pairs of <v_i, v_j> x_i x_j)."""

    slots: dict[int, int]  # bucket -> row of the weights; the last row is the text's length
    bias: float
    w: np.ndarray
    v: np.ndarray


def vector(text: str | None, kept: dict[int, int] | None, known: dict[str, tuple[int, ...]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of a text: log(1 + count) of each bucket (of its row, with ``kept``).

    The length, log(1 + words) / 4, is the last: its pairs with the terms let a term count for
    less in a long text.
    """
    words = Counter(_WORDS.findall(text.lower())) if text else {}
    sums: dict[int, int] = {}
    total = 0
    for word, n in words.items():
        total += n
        ids = known.get(word)
        if ids is None:
            ids = terms(word)
            if kept is not None:
                ids = tuple(kept[i] for i in ids if i in kept)
            if len(known) >= REMEMBERED:
                known.clear()
            known[word] = ids
        for i in ids:
            sums[i] = sums.get(i, 0) + n
    ids = np.fromiter(sums, np.int64, len(sums))
    values = np.log1p(np.fromiter(sums.values(), float, len(sums)))
    return np.append(ids, len(kept) if kept is not None else BUCKETS), np.append(values, np.log1p(total) / 4)


def _select(ids: list[np.ndarray], y: np.ndarray) -> dict[int, int]:
    """Rows for the KEPT buckets whose presence tells most about the label (G statistic)."""
    seen = np.zeros((2, BUCKETS + 1))
    for row, label in zip(ids, y, strict=True):
        seen[int(label), row] += 1
    n = np.array([[(y == 0).sum()], [(y == 1).sum()]], float)
    expected = seen.sum(0) * n / max(1.0, n.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(o > 0, o * np.log(o / e), 0) for o, e in ((seen, expected), (n - seen, n - expected)))
    g = np.nan_to_num(g).sum(0)
    g[BUCKETS] = 0
    best = np.argsort(-g, kind="stable")[:KEPT]
    return {int(b): k for k, b in enumerate(sorted(best[g[best] > 0].tolist()))}


def train(ids: list[np.ndarray], values: list[np.ndarray], y: np.ndarray) -> Model:
    """Logistic loss, AdaGrad over mini-batches in an order fixed by the seed."""
    slots = _select(ids, y)
    rng = np.random.default_rng(SEED)
    m = len(slots) + 1
    lookup = np.full(BUCKETS + 1, -1)
    lookup[list(slots)] = list(slots.values())
    lookup[BUCKETS] = m - 1
    rows = []
    for i, x in zip(ids, values, strict=True):
        at = lookup[i]
        rows.append((at[at >= 0], x[at >= 0]))
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    bias, w, v = np.log(rate / (1 - rate)), np.zeros(m), rng.normal(0, 0.05, (m, FACTORS))
    sq_b, sq_w, sq_v = 1.0, np.full(m, 0.1), np.full((m, FACTORS), 0.1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            batch = order[at : at + BATCH]
            idx = np.concatenate([rows[r][0] for r in batch])
            x = np.concatenate([rows[r][1] for r in batch])
            doc = np.repeat(np.arange(len(batch)), [len(rows[r][0]) for r in batch])
            starts = np.searchsorted(doc, np.arange(len(batch)))
            xv = v[idx] * x[:, None]
            s = np.add.reduceat(xv, starts)
            z = bias + np.add.reduceat(w[idx] * x, starts) + 0.5 * (s**2 - np.add.reduceat(xv**2, starts)).sum(1)
            grad = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]
            gx = grad[doc] * x
            used, inverse = np.unique(idx, return_inverse=True)
            gw = np.bincount(inverse, gx) / len(batch) + DECAY * w[used]
            gv = np.stack([np.bincount(inverse, gx * (s[doc, f] - xv[:, f])) for f in range(FACTORS)], 1) / len(batch) + DECAY * v[used]
            gb = grad.mean()
            sq_b += gb * gb
            sq_w[used] += gw * gw
            sq_v[used] += gv * gv
            bias -= RATE * gb / np.sqrt(sq_b)
            w[used] -= RATE * gw / np.sqrt(sq_w[used])
            v[used] -= RATE * gv / np.sqrt(sq_v[used])
    return Model(slots, float(bias), w, v)


def score(model: Model, ids: np.ndarray, x: np.ndarray) -> float:
    xv = model.v[ids] * x[:, None]
    z = model.bias + model.w[ids] @ x + 0.5 * (xv.sum(0) ** 2 - (xv**2).sum(0)).sum()
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The model of rows (text, toxic), with toxic 0 or 1; null labels are left out.

    About ``fit_rows`` rows at most are taken, by a hash of all their columns. Spark makes their
    vectors; one task, which sees those bounded rows only, trains, and returns at most KEPT + 1
    rows of weights.
    """
    rows = sampled(rows.where("toxic is not null"), fit_rows).select("text", F.col("toxic").cast("double").alias("toxic"))

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for part in parts:
            made = [vector(t, None, known) for t in part["text"]]
            yield pd.DataFrame({"key": [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in part["text"]], "toxic": part["toxic"], "ids": [i.astype(np.int32) for i, _ in made], "x": [x.astype(np.float32) for _, x in made]})

    def weights(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "toxic"], kind="stable")
        fitted = train([np.asarray(i) for i in part["ids"]], [np.asarray(x, float) for x in part["x"]], part["toxic"].to_numpy())
        buckets = [*fitted.slots, -1]
        return pd.DataFrame({"bucket": buckets, "w": fitted.w, "v": list(fitted.v), "bias": fitted.bias})

    made = rows.mapInPandas(vectors, "key bigint, toxic double, ids array<int>, x array<float>")
    found = made.withColumn("model", F.lit(0)).groupBy("model").applyInPandas(weights, "bucket bigint, w double, v array<double>, bias double").toPandas()
    if not len(found):
        return Model({}, 0.0, np.zeros(1), np.zeros((1, FACTORS)))
    slots = {int(b): k for k, b in enumerate(found["bucket"][:-1])}
    return Model(slots, float(found["bias"].iloc[0]), found["w"].to_numpy(), np.stack(found["v"].to_list()))


def scored(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """The rows with a toxicity score from 0 to 1, of the whole text.

    Null and empty texts get the score of a text without words. Whole texts are read, however
    long, and equal texts get equal scores. Every row stays; a column named ``out`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        model, known = held.value, {}
        return pd.Series([score(model, *vector(t, model.slots, known)) for t in texts], dtype=float)

    return docs.withColumn(out, predict(F.col(text)))


def training_rows(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, toxic) of labelled documents outside the held-out fold, one for each id.

    Repeated labels count once, as 1 if any is; of rows with equal ids the least text counts.
    About ``fit_rows`` labels at most are drawn, by a hash of the id, before they meet the
    texts, so what is broadcast has that bound.
    """
    learn = labels.where(~held_out(F.col("doc_id"), 4, 2)).where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learn = sampled(learn, fit_rows)
    met = docs.select("doc_id", "text").join(F.broadcast(learn), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a model of the labels outside the held-out fold."""
    docs = read(spark, sf_dir, "documents")
    model = fit(training_rows(docs, read(spark, sf_dir, "labels")))
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
