"""From raw documents to token ids, in five stages.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns the rows for the next stage, which reads
them from Parquet. All but the last return the columns of documents. run() applies them to the documents of a folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import bpe, jaccard, langid, mixing, toxicity
from leafwise.llm.common import held_out, importable, read, unused, written

#: A document is rejected if no language is found or its main language has less than this share.
LEAST_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language, by the mixture model learned from the labelled part of docs."""
    importable(spark)
    names = tuple(unused(docs, "lang_pred", "score", "languages", "proportions"))
    model = langid.learn(docs.where(~held_out()))
    found = langid.identify(docs, model, names=names)
    return found.where((F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[1]) >= LEAST_SHARE)).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score leaves below its threshold."""
    importable(spark)
    names = tuple(unused(docs, "score", "predicted"))
    model = toxicity.learn(docs, read(spark, sf_dir, "labels").where(~held_out()), toxicity.character_model(docs))
    return toxicity.score_documents(docs, model, names=names).where(F.col(names[1]) == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: five-word shingles, Jaccard measure 0.8 or more."""
    importable(spark)
    return jaccard.one_of_each(docs, width=5, part=80, whole=100)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, some repeated, some left out, so that the sources' words come near their targets."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every document of the mix."""
    importable(spark)
    found = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mix_sources", mix), ("byte_bpe", encode)]
#: SQL can express neither the models of the first stages nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
