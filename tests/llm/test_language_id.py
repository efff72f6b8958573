import itertools
import math
import random

import numpy as np
from util import DOCS, docs, rows

from recollect.llm import language_id as lid
from recollect.llm.common import held_out

WORDS = {"en": "the of and with thing other".split(), "fr": "le de être à nôtre chose".split(), "de": "der und über nicht schön ding".split()}


def corpus(spark, n=240):
    rng = random.Random(0)
    out = []
    for k in range(n):
        lang = list(WORDS)[k % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "e", "n"]) for _ in range(rng.choice([2, 30, 200]))), lang, "s", 1))
    return spark.createDataFrame(out, DOCS)


def test_held_out_accuracy_and_odd_texts(spark):
    df = corpus(spark)
    model = lid.fit(lid.training_rows(df))
    assert model.langs == ["de", "en", "fr"]
    found = lid.identified(df, model).withColumn("held", held_out(lid.F.col("doc_id"), 5, 0))
    held = found.where("held").collect()
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.collect())
    odd = docs(spark, [None, "", "123 !?", "the", "the", "\ud7ff 漢字", "x" * 200_000, "🙂 🙂!", "𝒳𐍈"]).selectExpr("*", "'a' as lang_pred_", "2 as score_")
    got = rows(lid.identified(odd, model), "doc_id", "lang_pred")
    assert got[:3] == [(0, "und"), (1, "und"), (2, "und")] and got[3][1] == got[4][1] == "en" and got[5][1] in model.langs and got[7][1] == "und" and got[8][1] in model.langs


def test_counts_match_those_of_one_process(spark):
    df = corpus(spark, 60)
    model = lid.fit(df)
    seen = np.zeros((lid.BUCKETS, 3))
    for r in df.collect():
        b, n, _ = lid.gram_counts(r.text)
        seen[b, model.langs.index(r.lang)] += n
    assert np.allclose(model.likelihood, (seen + lid.SMOOTHING) / (seen.sum(0) + lid.SMOOTHING * lid.BUCKETS))


def test_mixture_finds_both_languages_and_their_shares(spark):
    model = lid.fit(corpus(spark))
    rng = random.Random(3)
    part = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    share = lid.mixture(model, part("fr", 300) + " " + part("de", 150))
    assert list(share) == ["fr", "de"] and 0.5 < share["fr"] < 0.8 and abs(sum(share.values()) - 1) < 1e-6
    assert lid.mixture(model, part("en", 300)) == {"en": 1.0}
    found = lid.identified(docs(spark, [part("fr", 300) + " " + part("de", 150), part("en", 9), None]), model)
    got = rows(found, "doc_id", "lang_pred", "langs", "score")
    assert [r[1:3] for r in got] == [("fr", "fr,de"), ("en", "en"), ("und", "")] and abs(got[0][3] - share["fr"]) < 1 and (got[1][3], got[2][3]) == (1.0, 0.0)


def plain_em(likelihood, grams, langs, rounds):
    """Proportions and log-likelihood, n-gram by n-gram."""
    share = {k: 1 / len(langs) for k in langs}
    for _ in range(rounds):
        sums = dict.fromkeys(langs, 0.0)
        for b, n in grams.items():
            all_ = sum(share[k] * likelihood[b][k] for k in langs)
            for k in langs:
                sums[k] += n * share[k] * likelihood[b][k] / all_
        share = {k: v / sum(grams.values()) for k, v in sums.items()}
    return share, sum(n * math.log(sum(share[k] * likelihood[b][k] for k in langs)) for b, n in grams.items())


def test_set_is_the_best_of_all_subsets_by_plain_em(spark):
    model = lid.fit(corpus(spark))
    rng = random.Random(11)
    part = lambda lang, n: [rng.choice(WORDS[lang]) + rng.choice(["", "e", "n"]) for _ in range(n)]
    for sizes in ((40, 0, 0), (0, 3, 0), (60, 50, 0), (0, 30, 80), (90, 70, 80), (200, 4, 0), (1, 0, 1), (0, 0, 25)):
        text = " ".join(w for lang, n in zip(WORDS, sizes, strict=True) for w in part(lang, n))
        buckets, counts, _ = lid.gram_counts(text)
        grams = {int(b): float(n) for b, n in zip(buckets, counts, strict=True)}
        price = lid.PENALTY * math.log(sum(grams.values()) + 1) / 2
        tried = {}
        for langs in (x for n in (1, 2, 3) for x in itertools.combinations(range(3), n)):
            share, value = plain_em(model.likelihood, grams, langs, lid.ROUNDS)
            tried[langs] = (value - price * (len(langs) - 1), share)
        best = max(tried, key=lambda x: tried[x][0])
        got = lid.mixture(model, text)
        assert set(got) == {model.langs[k] for k in best}
        assert all(abs(got[model.langs[k]] - v) < 1e-9 for k, v in tried[best][1].items())


def test_clashing_columns_stay_and_outputs_replace(spark):
    df = corpus(spark, 30)
    model = lid.fit(df)
    odd = df.selectExpr("*", "'keep' as _id", "'keep' as doc", "'keep' as found", "'gone' as score", "'keep' as `a.b`")
    found = lid.identified(odd, model)
    assert sorted(found.columns) == sorted([*odd.columns, "lang_pred", "langs"]) and dict(found.dtypes)["score"] == "double"
    assert {(r["_id"], r["doc"], r["found"], r["a.b"]) for r in found.collect()} == {("keep",) * 4}


def test_languages_of_a_fit_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lid, "FIT_LANGS", 2)
    df = corpus(spark, 60)
    assert lid.fit(df).langs == ["de", "en"]
    assert lid.fit(df.unionAll(df.where("lang = 'fr'")).unionAll(df.where("lang = 'de'"))).langs == ["de", "fr"]


def test_no_labels_and_no_rows(spark):
    model = lid.fit(docs(spark, ["text"], lang=None))
    assert model.langs == [] and rows(lid.identified(docs(spark, ["text"]), model), "lang_pred", "score") == [("und", 0.0)]
    assert lid.identified(docs(spark, ["x"]).limit(0), lid.fit(corpus(spark, 9))).count() == 0


def test_bounded_sample(spark):
    model = lid.fit(corpus(spark), fit_rows=60)
    assert model.langs == ["de", "en", "fr"]
