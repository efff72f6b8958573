"""Main text of web pages: boosted trees over DOM nodes, and a choice of nodes that fits the tree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import layouts
from recollect.llm.common import read
from recollect.llm.dom import NAMES, Tree, decoded, features, main_text, parsed

#: Pages of the table whose texts a fit lays out again, and the pages that it lays out and learns from.
FIT_PAGES, LAID_OUT = 200, 1200
#: Boosting: trees, their depth, shrinkage, bins of a feature, and the weight that a leaf is pulled to 0 with.
TREES, DEPTH, RATE, BINS, PULL = 60, 5, 0.25, 32, 2.0
SEED = 23
#: Characters of HTML that a task holds parsed at once; a longer page is taken alone.
HELD = 1 << 20


@dataclass(frozen=True)
class Model:
    """Log-odds of a node: the bias, and a leaf of each tree. A tree asks DEPTH questions, ``bin > cut``."""

    edges: list[np.ndarray]
    feature: np.ndarray  # trees x (2**DEPTH - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2**DEPTH
    bias: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x).ravel()
        start = np.arange(len(x)) * len(self.edges)
        out = np.full(len(x), self.bias)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (bins[start + feature[at]] > cut[at])
            out += leaf[at - (2**DEPTH - 1)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Model:
    """Gradient-boosted trees of logistic loss, grown level by level over binned features."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for k in range(x.shape[1])]
    rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.uint8), np.zeros((trees, leaves))
    model = Model(edges, feature, cut, leaf, float(np.log(rate / (1 - rate))))
    if not len(y):
        return model
    bins = model.binned(x)
    score = np.full(len(y), model.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            low, many = 2**level - 1, 2**level
            node = at - low
            best = np.full(many, 1e-6)
            for k in range(x.shape[1]):
                cell = node * BINS + bins[:, k]
                sg = np.bincount(cell, g, many * BINS).reshape(many, BINS).cumsum(1)
                sh = np.bincount(cell, h, many * BINS).reshape(many, BINS).cumsum(1)
                all_g, all_h = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + PULL) + (all_g - sg) ** 2 / (all_h - sh + PULL) - all_g**2 / (all_h + PULL)
                gain[(sh < 1) | (all_h - sh < 1)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                best[better] = gain[np.arange(many), top][better]
                feature[t, low : low + many][better] = k
                cut[t, low : low + many][better] = top[better]
            at = 2 * at + 1 + (bins[np.arange(len(y)), feature[t, at]] > cut[t, at])
        at -= inner
        leaf[t] = RATE * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + PULL)
        score += leaf[t, at]
    return model


def truths(t: Tree) -> np.ndarray:
    """Of each node of a training page: 1 if it holds main text, 0 if it holds other text only, -1 if none is labelled."""
    out = np.full(len(t.tag), -1)
    for k in range(len(t.tag) - 1, -1, -1):
        if t.tag[k] == "#block":
            out[k] = t.truth[k]
        if t.parent[k] >= 0:
            out[t.parent[k]] = max(out[t.parent[k]], out[k])
    return out


def fitted(pages: list[str], laid_out: int = LAID_OUT) -> Model:
    """A model of pages laid out by ``layouts`` from the texts of some pages, or from its own words where there are none."""
    texts = [x for page in pages for x in parsed(page).text if x]
    sentences = sorted({s for x in texts for s in re.split(r"(?<=[.!?])\s+", x) if 3 <= len(s) <= 400})
    phrases = sorted({x for x in texts if len(x) <= 40})
    trees = [parsed(p) for p in layouts.pages(SEED, laid_out, sentences[:20_000], phrases[:5_000])]
    y = np.concatenate([truths(t) for t in trees])
    x = features(trees)
    return boosted(x[y >= 0], y[y >= 0].astype(float))


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, column: str = "html") -> Model:
    """The model, trained in one task from the ``fit_pages`` different pages with the least hashes."""
    hashed = pages.select(F.col(column).alias("page"), F.xxhash64(F.lit(5), F.col(column)).alias("h")).where("page is not null")
    least = hashed.select("h").distinct().orderBy("h").limit(fit_pages)
    some = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("page").alias("page")).select("page")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        m = fitted(sorted(rows["page"].dropna()))
        return pd.DataFrame({"bias": [m.bias], "edges": [[e.astype(float).tolist() for e in m.edges]], "feature": [m.feature.tolist()], "cut": [m.cut.astype(int).tolist()], "leaf": [m.leaf.tolist()]})

    # A row without a page, so that a table without pages has a model too.
    base = pages.sparkSession.range(1).select(F.lit(None).cast("string").alias("page"))
    (m,) = some.union(base).withColumn("model", F.lit(0)).groupBy("model").applyInPandas(learn, "bias double, edges array<array<double>>, feature array<array<int>>, cut array<array<int>>, leaf array<array<double>>").collect()
    return Model([np.array(e) for e in m["edges"]], np.array(m["feature"]), np.array(m["cut"], np.uint8), np.array(m["leaf"]), m["bias"])


def extract(pages: list[str | None], model: Model) -> list[str]:
    """The main text of each page."""
    trees = [parsed(p) for p in pages]
    size = np.cumsum([len(t.tag) for t in trees])
    score = np.clip(model.score(features(trees)), -8, 8)
    return [main_text(t, decoded(t, s)) for t, s in zip(trees, np.split(score, size[:-1]), strict=True)]


def main_texts(pages: DataFrame, model: Model, column: str = "html", out: str = "text") -> DataFrame:
    """The rows with the main text of their page.

    Blocks that are kept stand in page order with an empty line between; character references are
    decoded, and white space in a block is one space. Null and empty pages, and pages without an article, have
    an empty text; a page of plain text is one block. Very long pages are read whole. A text occurs as often as
    the page repeats it. Every row stays, equal ones too; a column named ``out`` is replaced.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def extracted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            found: list[str] = []
            held: list[str | None] = []
            size = 0
            for page in part:
                held.append(page)
                size += len(page or "")
                if size >= HELD or len(held) == 256:
                    found += extract(held, sent.value)
                    held, size = [], 0
            yield pd.Series(found + (extract(held, sent.value) if held else []), dtype=object)

    return pages.withColumn(out, extracted(F.col(column)))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page of ``pages``, by a model trained on layouts of some of their texts."""
    pages = read(spark, sf_dir, "pages")
    found = main_texts(pages.select("page_id", "url", "html"), fit(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
