"""The queries of this subpackage: thin functions over the operators, with SQL where SQL can say the same."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import ann, bpe, fingerprint, hosts, jaccard, langid, mixing, toolcalls, toxicity, warc
from .common import held_out, importable, read

_FOUND: dict = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        _FOUND[name] = run
        if sql:
            _SQL[name] = sql.strip()
        return f

    return add


@_query("op1_url_filter", hosts.ORACLE)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge(read(spark, sf_dir, "pages")).drop("trust", "distrust")


@_query("op2_tool_calls", toolcalls.ORACLE)
def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations")
    held, answers = toolcalls.extracted(messages)
    calls, results = toolcalls.turns_as_calls(messages)
    return toolcalls.link(held.unionByName(calls), answers.unionByName(results), toolcalls.REPLY)


@_query("op3_warc", warc.ORACLE)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.fetch(warc.write(read(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@_query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out()))
    found = langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages", "proportions")


@_query("op5_nearest_vectors")
def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@_query("op6_byte_bpe")
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@_query("op7_fingerprints", fingerprint.ORACLE)
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(read(spark, sf_dir, "documents"))


@_query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    letters = toxicity.character_model(docs)
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(~held_out()), letters)
    scored = toxicity.score_documents(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@_query("op9_jaccard_join", jaccard.ORACLE)
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.classes(read(spark, sf_dir, "documents"), width=4, part=85, whole=100)
    return found.select("doc_id", "n_shingles", "component_id")


@_query("op10_mix_sources", mixing.ORACLE)
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.systematic_copies(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@_query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
