import random

import numpy as np
import pytest
from util import DOCS, docs, rows

from recollect.llm import toxicity as t
from recollect.llm.common import held_out


def corpus(spark, n=400):
    """Toxic: an insult together with a mention of a group; either alone is harmless."""
    rng = random.Random(1)
    words = [f"word{k}" for k in range(200)]
    out, labels = [], []
    for k in range(n):
        kind = k % 4
        text = [rng.choice(words) for _ in range(rng.choice([20, 60]))] + ["silly"] * 2 * (kind in (1, 3)) + ["neighbours"] * 2 * (kind in (2, 3))
        rng.shuffle(text)
        out.append((k, " ".join(text), "en", "s", 1))
        labels.append((k, 1, int(kind == 3)))
    return spark.createDataFrame(out, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_pairs_of_terms_are_learned(spark):
    df, labels = corpus(spark)
    model = t.fit(t.training_rows(df, labels))
    found = t.scored(df, model).join(labels, "doc_id").withColumn("held", held_out(t.F.col("doc_id"), 4, 2))
    held = found.where("held").collect()
    right = sum((r.score >= t.CUT) == bool(r.toxic) for r in held)
    assert len(held) > 50 and right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_score_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = t.Model({}, 0.3, rng.normal(size=6), rng.normal(size=(6, t.FACTORS)))
    ids, x = np.array([0, 2, 5]), np.array([0.5, 1.0, 2.0])
    z = 0.3 + model.w[ids] @ x + sum(model.v[ids[a]] @ model.v[ids[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert t.score(model, ids, x) == pytest.approx(1 / (1 + np.exp(-z)))


def test_a_step_of_training_follows_the_loss(monkeypatch):
    """One batch of AdaGrad, against derivatives of the loss taken by differences."""
    monkeypatch.setattr(t, "EPOCHS", 1)
    rng = np.random.default_rng(4)
    ids = [np.append(rng.choice(12, 4, replace=False), t.BUCKETS) for _ in range(20)]
    values = [rng.random(5) + 0.2 for _ in range(20)]
    y = np.array([int(3 in i or k % 7 == 0) for k, i in enumerate(ids)], float)
    model = t.train(ids, values, y)
    m = len(model.slots) + 1
    v0, bias0 = np.random.default_rng(t.SEED).normal(0, 0.05, (m, t.FACTORS)), np.log(y.mean() / (1 - y.mean()))
    rows_ = [([model.slots.get(int(b), m - 1 if b == t.BUCKETS else None) for b in i], x) for i, x in zip(ids, values, strict=True)]

    def loss(bias, w, v):
        total = 0.0
        for (at, x), label in zip(rows_, y, strict=True):
            own = [(k, z) for k, z in zip(at, x, strict=True) if k is not None]
            z = bias + sum(w[k] * a for k, a in own) + sum(v[k] @ v[j] * a * b for n, (k, a) in enumerate(own) for j, b in own[:n])
            total += np.log1p(np.exp(z)) - label * z
        return total / len(y) + t.DECAY / 2 * ((w**2).sum() + (v**2).sum())

    def slope(change):
        e = 1e-5
        return (change(e) - change(-e)) / (2 * e)

    w0 = np.zeros(m)
    gb = slope(lambda e: loss(bias0 + e, w0, v0))
    assert model.bias == pytest.approx(bias0 - t.RATE * gb / np.sqrt(1 + gb * gb), abs=1e-6)
    for k in range(m):
        one = np.eye(m)[k]
        g = slope(lambda e: loss(bias0, e * one, v0))  # noqa: B023
        assert model.w[k] == pytest.approx(-t.RATE * g / np.sqrt(0.1 + g * g), abs=1e-6)
        for f in range(t.FACTORS):
            part = np.zeros((m, t.FACTORS))
            part[k, f] = 1
            g = slope(lambda e: loss(bias0, w0, v0 + e * part))  # noqa: B023
            assert model.v[k, f] == pytest.approx(v0[k, f] - t.RATE * g / np.sqrt(0.1 + g * g), abs=1e-6)


def test_rows_that_share_an_id_count_once_in_a_fit(spark):
    df, labels = corpus(spark, 40)
    learn = t.training_rows(df.unionAll(df).unionAll(df.selectExpr("doc_id", "concat('zzz ', text) as text", "lang", "source", "n_chars")), labels)
    assert sorted(map(str, learn.collect())) == sorted(map(str, t.training_rows(df, labels).collect()))


def test_whole_texts_odd_texts_and_repeats(spark):
    df, labels = corpus(spark)
    model = t.fit(t.training_rows(df, labels.union(labels)))
    long = "calm " * 50_000 + "silly neighbours " * 50_000
    got = rows(t.scored(docs(spark, [None, "", "silly neighbours silly neighbours", "silly neighbours silly neighbours", long]).withColumn("toxic", t.F.lit("x")), model), "doc_id", "score")
    assert got[0][1] == got[1][1] and got[2][1] == got[3][1] and got[4][1] > got[0][1]
    assert t.scored(df.limit(0), model).count() == 0


def test_one_class_no_labels(spark):
    df, labels = corpus(spark, 40)
    for some in (labels.where("toxic = 0"), labels.limit(0), labels.withColumn("toxic", t.F.lit(None).cast("int"))):
        scores = [r.score for r in t.scored(df, t.fit(t.training_rows(df, some))).collect()]
        assert len(scores) == 40 and all(0 <= s <= 1 for s in scores)


def test_reruns_agree(spark):
    df, labels = corpus(spark, 100)
    a, b = (t.fit(t.training_rows(x, labels)) for x in (df, df.repartition(5)))
    assert a.slots == b.slots and np.allclose(a.w, b.w) and np.allclose(a.v, b.v)
