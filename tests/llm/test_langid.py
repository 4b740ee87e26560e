"""Held-out accuracy, mixtures, and texts that tell nothing."""

import itertools
import os
import random

import numpy as np
import pytest

from leafwise.llm import langid
from leafwise.llm.common import held_out, importable

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out_accuracy_and_mixture(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs.where(~held_out()))
    rows = langid.identify(docs, model).where(held_out()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    text = {r.lang: r.text for r in docs.where("n_chars > 800").collect()}
    (main, score, langs, shares), = langid.infer([" ".join([text["en"][:800], text["fr"][:400]])], model)
    assert main == "en" and set(langs) == {"en", "fr"} and 0.5 < score < 0.85 and abs(sum(shares) - 1) < 1e-5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_a_mixture_of_all_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs.where(~held_out()))
    text = {r.lang: r.text for r in docs.where("n_chars > 800").collect()}
    (_, score, langs, shares), = langid.infer([" ".join(text[x][:800] for x in model.languages)], model)
    assert len(model.languages) == 4 and set(langs) == set(model.languages)
    assert abs(sum(shares) - 1) < 1e-5 and min(shares) > 0.1 and score == max(shares) < 0.4


def test_texts_without_letters_and_clashing_columns(spark, table):
    importable(spark)
    rows = [(i, "the cat and the dog went home " * 3, "en", "s", 1) for i in range(8)] + [(i, "le chat et le chien sont dans la maison " * 3, "fr", "s", 1) for i in range(8, 16)]
    model = langid.learn(table([*rows, (90, None, "en", "s", 1), (91, "x", None, "s", 1)]))
    assert model.languages == ["en", "fr"]
    docs = table([(1, None, None, None, None), (2, "123 !?", "en", "s", 1), (3, "le chat dans la maison", "xx", "s", 1), (3, "le chat dans la maison", "xx", "s", 1), (4, "the dog " * 50_000, "fr", "s", 1)]).withColumnRenamed("source", "score")
    names = ("p_", "s_", "l_", "x_")
    got = [(r.doc_id, r.p_) for r in langid.identify(docs, model, names=names).orderBy("doc_id").collect()]
    assert got == [(1, "und"), (2, "und"), (3, "fr"), (3, "fr"), (4, "en")]
    assert langid.identify(docs.limit(0), model, keep=["doc_id"]).count() == 0


def test_nothing_learned(spark, table):
    model = langid.learn(table([(1, "text", None, "s", 1)]))
    assert model.languages == [] and langid.infer(["some text", ""], model) == [("und", 0.0, [], [])] * 2


def test_stretches_change_nothing(monkeypatch, spark, table):
    model = langid.learn(table([(1, "alpha beta gamma", "a", "s", 1), (2, "uno dos tres", "b", "s", 1)]))
    text = "alpha beta uno gamma dos " * 400
    want = langid.word_likelihoods(text, model)
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 100)
    assert (langid.word_likelihoods(text, model) == want).all()


def test_em_raises_the_likelihood(monkeypatch):
    monkeypatch.setattr(langid, "MOST_ROUNDS", 1)
    draw = np.random.default_rng(0)
    like = draw.random((50, 3)).astype(np.float32)
    share, last = np.full((1, 3), 1 / 3, np.float32), -np.inf
    for _ in range(5):
        share, fit = langid._em(like, np.array([50]), share)
        assert fit[0] >= last - 1e-4
        last = fit[0]


def plain_mixture(like, held):
    """Proportions of the languages held, after many rounds, and the log likelihood; one document, double precision."""
    share = np.zeros(like.shape[1])
    share[held] = 1 / len(held)
    for _ in range(3_000):
        resp = like * share
        share = (resp / resp.sum(axis=1, keepdims=True)).mean(axis=0)
    return share, float(np.log((like * share).sum(axis=1)).sum())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_sets_equal_the_best_of_all_subsets(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.learn(docs.where(~held_out()))
    draw, words = random.Random(7), {r.lang: r.text.split() for r in docs.where("n_chars > 1500").collect()}
    texts = []
    for k in range(60):
        some = draw.sample(model.languages, 1 + k % 4)
        texts.append(" ".join(w for x in some for w in draw.sample(words[x], draw.randint(2, 60))))
    same = 0
    for text, (main, _, langs, shares) in zip(texts, langid.infer(texts, model), strict=True):
        logs = langid.word_likelihoods(text, model).astype(float)
        like, n = np.exp(logs - logs.max(axis=1, keepdims=True)), len(logs)
        every = [list(c) for k in range(1, 5) for c in itertools.combinations(range(len(model.languages)), k)]
        costs = [-2 * plain_mixture(like, c)[1] + (2 * len(c) - 1) * np.log(max(n, 2)) for c in every]
        best = every[int(np.argmin(costs))]
        same += {model.languages[i] for i in best} == set(langs)
        if {model.languages[i] for i in best} == set(langs):
            share, _ = plain_mixture(like, best)
            assert np.allclose([share[model.languages.index(x)] for x in langs], shares, atol=0.02) and main == model.languages[int(share.argmax())]
        else:  # only where two sets cost nearly the same
            mine = every.index(sorted(model.languages.index(x) for x in langs))
            assert costs[mine] - min(costs) < 3
    assert same >= 57
