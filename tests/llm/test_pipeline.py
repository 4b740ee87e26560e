"""The pipeline's stages in their order, each on all that its predecessor kept."""

import os

import pytest

import corpus_pipeline
from leafwise.llm import langid, queries, toxicity
from leafwise.llm.common import held_out
from tests.llm.test_jaccard import brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages_equal_a_plain_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, DATA).cache()
    assert kept.columns == docs.columns
    model = langid.learn(docs.where(~held_out()))
    rows = docs.collect()
    want = {r.doc_id for r, x in zip(rows, langid.infer([r.text for r in rows], model), strict=True) if x[0] != "und" and x[1] >= corpus_pipeline.LEAST_SHARE}
    assert {r.doc_id for r in kept.collect()} == want and len(want) > 0.97 * len(rows)
    clean = corpus_pipeline.toxic(spark, kept, DATA).cache()
    scorer = toxicity.Scorer(toxicity.learn(kept, spark.read.parquet(f"{DATA}/labels.parquet").where(~held_out()), toxicity.character_model(kept)))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in kept.collect() if scorer.score(r.text) < toxicity.THRESHOLD}
    single = corpus_pipeline.near_duplicates(spark, clean, DATA).cache()
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute(texts, 5, 80, 100)})
    mixed = corpus_pipeline.mix(spark, single, DATA).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    last = corpus_pipeline.encode(spark, mixed, DATA)
    assert last.count() == mixed.count() and last.where("n_tokens <> size(ids)").count() == 0


def test_run_and_registration(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "near_duplicates", "mix_sources", "byte_bpe"]
    assert corpus_pipeline.run(spark, DATA).count() > 100
    found = queries.queries()
    assert "pipeline" in found and sorted(int(k[2:].split("_")[0]) for k in found if k.startswith("op")) == list(range(1, 11))


def test_clashing_columns_and_nulls(spark):
    rows = [(1, None, None, None, None, 0.5), (2, "12 34", "en", "s", 5, None), (3, "the word and the other", "en", None, 22, 1.0), (3, "the word and the other", "en", None, 22, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        out.collect()
    assert corpus_pipeline.encode(spark, docs, DATA).count() == 4
    assert all(stage(spark, docs.limit(0), DATA).count() == 0 for _, stage in corpus_pipeline.STAGES)
