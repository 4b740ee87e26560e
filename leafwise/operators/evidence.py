"""From analysed pages to a classification of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def spine(docs: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, page, kept columns): one row for each of the page_count pages. Documents without pages have none."""
    return docs.where("page_count > 0").select("doc_id", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page"), *keep)


def with_text(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """pages with text of (doc_id, page, text); null where there is none."""
    return pages.join(texts.select("doc_id", "page", "text"), ["doc_id", "page"], "left")


def evidence(docs: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per page with its reasons and flags. docs: doc_id, page_count, flagged, tables, columns (arrays of 0-based pages), reasons
    (array of page, reasons), has_encoding_issues. Without texts the text column isn't read at all."""
    pages = spine(docs, "flagged", "tables", "columns", "reasons", "has_encoding_issues")
    page = F.col("page")
    own = F.flatten(F.transform(F.filter("reasons", lambda r: r["page"] == page), lambda r: r["reasons"]))
    pages = pages.select("doc_id", "page", own.alias("reasons"), F.array_contains("flagged", page).alias("flagged_by_inspector"), F.array_contains("tables", page).alias("has_tables"), F.array_contains("columns", page).alias("has_columns"), "has_encoding_issues")
    return with_text(pages, texts) if texts is not None else pages


def skips_analysis(reported: Column, pages: Column, n: Column) -> Column:
    """Whether the layout pass is left out: the label before the judge says scan or image."""
    return C.label(reported, pages, n).isin("scanned", "image_based")


def _status(judged: Column, n: Column) -> Column:
    """What is wrong with the list of pages that have verdicts. Order of checks: their number, pages out of range, pages more than once."""
    wrong = F.when(F.size(judged) != n, "wrong_count").when(F.exists(judged, lambda p: (p >= n) | (p < 0)), "out_of_range").when(F.size(F.array_distinct(judged)) != F.size(judged), "duplicate")
    return F.coalesce(wrong, F.lit("ok"))


def contract(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc_id, status): ok if a document has one verdict for each page and none besides, else what is wrong."""
    found = verdicts.groupBy("doc_id").agg(F.collect_list("page").alias("judged"))
    joined = docs.select("doc_id", "page_count").join(found, "doc_id", "left")
    return joined.select("doc_id", _status(F.coalesce("judged", C.no_pages()), F.col("page_count")).alias("status"))


def classify(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs with pages_needing_ocr, pdf_type, a finite confidence and contract (ok, or what is wrong with the verdicts), from (doc_id, page, needs_ocr).

    docs: doc_id, reported, page_count, confidence, and what is to be carried. Pages are gathered per document, whose number is bounded.
    A document whose verdicts are not one a page keeps no page for OCR by them: its caller takes it for failed.
    """
    found = verdicts.groupBy("doc_id").agg(F.collect_list("page").alias("judged"), F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page")))).alias("pages_needing_ocr"))
    joined = docs.join(found, "doc_id", "left").withColumn("contract", _status(F.coalesce("judged", C.no_pages()), F.col("page_count"))).drop("judged")
    joined = joined.withColumn("pages_needing_ocr", F.when(F.col("contract") == "ok", F.coalesce("pages_needing_ocr", C.no_pages())).otherwise(C.no_pages()))
    joined = joined.withColumn("pdf_type", C.label(F.col("reported"), F.col("pages_needing_ocr"), F.col("page_count")))
    return joined.withColumn("confidence", C.finite_or_zero(F.col("confidence")))


def with_defaults(classified: DataFrame) -> DataFrame:
    """A classification from outside, with what callers leave out: pdf_type in any spelling; classify_ms 0, is_complex_layout and
    has_encoding_issues false and ocr_reasons empty where the column is missing or null."""
    out = classified.withColumn("pdf_type", C.loose_type(F.col("pdf_type"))) if "pdf_type" in classified.columns else classified
    for name, value in (("classify_ms", F.lit(0.0)), ("is_complex_layout", F.lit(False)), ("has_encoding_issues", F.lit(False)), ("ocr_reasons", F.array().cast("array<struct<page:int,reasons:array<string>>>"))):
        out = out.withColumn(name, F.coalesce(F.col(name), value) if name in classified.columns else value)
    return out
