"""Restoring and scoring."""

import math
import os

import numpy as np
import pytest

from leafwise.llm import toxicity
from leafwise.llm.common import held_out, importable

DATA = "/root/testdata/sf0.1"
CLEAN = "the quick people were reading a stupid little book about an idiot who liked to clown around with the others and then went home to rest "


@pytest.fixture(scope="module")
def letters(spark, table):
    importable(spark)
    return toxicity.character_model(table([(i, CLEAN * 5, "en", "s", 1) for i in range(4)] + [(9, None, None, None, None)]))


@pytest.mark.parametrize("hidden, plain", [("stuuupid", "stupid"), ("s.t.u.p.i.d", "stupid"), ("$tupid", "stupid"), ("1d10t", "idiot"), ("cl0wn", "clown"), ("c*lown", "clown"), ("st​upid", "stupid"), ("i-d-i-o-t", "idiot")])
def test_restoring(letters, hidden, plain):
    assert toxicity.restore_token(hidden, letters) == plain


def test_restoring_texts(letters):
    assert toxicity.restore("an i d i o t here", letters) == "an idiot here"
    clean = "Ordinary words, 2024-05-06, and well-known e.g. 3rd x2"
    assert toxicity.restore("people were reading", letters) == "people were reading" and "Ordinary words," in toxicity.restore(clean, letters)
    assert toxicity.restore_token("a" * 20_000, letters) in ("a", "aa")


@pytest.mark.parametrize("hidden, plain", [("stuupid", "stupid"), ("iddiot", "idiot"), ("IdDiot", "idiot"), ("cllown", "clown"), ("id-iot", "idiot"), ("id.iot", "idiot"), ("clo/wn", "clown"), ("id--iot", "idiot"), ("1diot", "idiot"), ("(id-iot,", "idiot")])
def test_one_doubled_letter_or_one_separator(letters, hidden, plain):
    if hidden[0] != "(":
        assert toxicity.restore_token(hidden, letters) == plain
    assert plain in toxicity.readings(hidden, letters)
    model = toxicity.Model(letters, 0.1, {plain: (0.5, 1e-7, True)})
    assert toxicity.Scorer(model).score(f"the people were reading the {hidden} of it") > toxicity.THRESHOLD > toxicity.Scorer(model).score("the people were reading of it")


def test_ordinary_writing_stands_for_itself_too(letters):
    assert toxicity.readings("letter", letters)[0] == "letter" and toxicity.readings("well-known", letters)[0] == "well-known"
    assert toxicity.readings("reading,", letters) == ["reading,"] and toxicity.readings("2024-05-06", letters) == ["2024-05-06"]


def test_viterbi_equals_exhaustive_search(letters):
    def every(token):
        out = [("", 0.0)]
        for k, c in enumerate(token):
            options = [(c, 0.0)] if c in toxicity._INDEX else []
            options += [(x, toxicity.SWAP) for x in toxicity.LEET.get(c, "")]
            if c in toxicity.SEPARATORS:
                options.append(("", toxicity.DROP))
            elif k and c == token[k - 1]:
                options.append(("", toxicity.REPEAT if (k > 1 and c == token[k - 2]) or token[k + 1 : k + 2] == c else toxicity.DOUBLE))
            elif c in toxicity.LEET:
                options.append(("", toxicity.ODD))
            out = [(t + o, s + p) for t, s in out for o, p in options]
        return out

    def cost(text, price):
        codes = [0, 0, *[toxicity._INDEX[c] for c in text], 0]
        return sum(float(letters[a, b, c]) for a, b, c in zip(codes, codes[1:], codes[2:], strict=False)) - price

    for token in ("st00pid", "1d1-ot", "cllown", "b00k"):
        best = max(cost(t, p) for t, p in every(token))
        got = toxicity.viterbi(token, letters)
        assert max(cost(t, p) for t, p in every(token) if t == got) == pytest.approx(best, abs=1e-4)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.learn(docs, labels.where(~held_out()), toxicity.character_model(docs))
    rows = toxicity.score_documents(docs.join(labels, "doc_id").where(held_out()), model).collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    caught, wrong = sum(r.predicted for r in toxic), sum(r.predicted for r in clean)
    assert caught >= 0.94 * len(toxic) and caught >= 0.97 * (caught + wrong) and wrong <= 0.01 * len(clean)
    hidden = toxicity.Scorer(model).score("the 1d1ot and the ththre $cum of it")
    assert hidden > 0.3


def test_rows_and_no_labels(spark, table, letters):
    docs = table([(1, None, None, None, None), (2, "", "en", "s", 0), (3, CLEAN, "en", "s", 1), (3, CLEAN, "en", "s", 1)]).withColumnRenamed("lang", "score")
    model = toxicity.learn(docs, spark.createDataFrame([(1, None), (None, 1), (3, 0)], "doc_id long, toxic int"), letters)
    got = toxicity.score_documents(docs, model, names=("s_", "p_")).collect()
    assert len(got) == 4 and {r.s_ for r in got} == {0.0} and {r.p_ for r in got} == {0}
    assert toxicity.score_documents(docs.limit(0), model, keep=["doc_id"]).count() == 0


def test_evidence_is_that_of_a_plain_count(letters):
    told = {"idiot": (0.4, 1e-5, True), "idio-": (0.5, 2e-5, False), "scum": (0.2, 1e-6, True)}
    text = "the idiot said scum and the idiot said scum! idiots read on " + "w " * 0 + " ".join(f"word{i}" for i in range(20))
    tokens = set(text.split())
    counts = {f: sum(f in toxicity.features(t) for t in tokens) for f in told}
    want = max(math.log(told[f][0]) - toxicity.EXTRA + k * math.log(1 + toxicity.EXTRA / (told[f][1] * len(tokens))) for f, k in counts.items() if k) + math.log(0.1 / 0.9)
    odds, hits, n = toxicity.Scorer(toxicity.Model(letters, 0.1, told)).evidence(text)
    assert (counts, hits, n) == ({"idiot": 1, "idio-": 2, "scum": 2}, 4, len(tokens)) and odds == pytest.approx(want)
    assert toxicity.Scorer(toxicity.Model(letters, 0.1, told)).evidence("") == (-math.inf, 0, 0)


def test_regression_finds_weights_and_keeps_the_prior():
    draw = np.random.default_rng(1)
    x = np.column_stack([np.ones(4_000), draw.normal(size=(4_000, 4))])
    true = np.array([-1.0, 1.5, 0.5, 0.0, -0.5])
    y = (draw.random(4_000) < 1 / (1 + np.exp(-x @ true))).astype(float)
    assert np.allclose(toxicity.regression(x, y, np.ones(4_000)), true, atol=0.2)
    assert toxicity.regression(x[:0], y[:0], y[:0]) == toxicity.PRIOR


def test_very_long_tokens(letters):
    assert len(toxicity.viterbi("st00pid1" * 25_000, letters)) > 100_000


def test_texts_together_count_as_apart():
    texts = ["the people", "", "reading, of", "é x\n\ny"]
    assert (toxicity.trigram_counts("\n".join(texts)) == sum(toxicity.trigram_counts(t) for t in texts)).all()
