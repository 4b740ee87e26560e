"""Planning: one ordered CASE over a classification, and the gates before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import BYPASS_TIER, Config
from ..functions import columns as C

LEG = "struct<model:string,tier:string,pages:array<int>>"


def ocr_tier(is_complex: Column, cfg: Config) -> Column:
    """The tier that OCR legs get: for complex layouts the configured one, as far as it has a model."""
    return F.when(is_complex, cfg.complex_tier()).otherwise("standard")


def model_for(tier: Column, cfg: Config) -> Column:
    return F.when(tier == "local", cfg.tiers.local).when(tier == "standard", cfg.tiers.standard).when(tier == "premium", F.lit(cfg.tiers.premium))


def leg(model: Column, tier: Column, pages: Column) -> Column:
    return F.struct(model.alias("model"), tier.alias("tier"), pages.alias("pages")).cast(LEG)


def plan(c: DataFrame, cfg: Config) -> DataFrame:
    """c with reason, tier, routed_model, legs and is_split. c: confidence (float), is_complex_layout, pages_needing_ocr, page_count.

    The rows of the table hold in order: too unsure; nothing needs OCR; everything does; no splitting; else a local leg for the
    text pages and an OCR leg for the rest. Pages out of range don't count. Null pages in a leg say the whole document.
    """
    cfg = cfg.validated()
    n, whole = F.col("page_count"), F.lit(None).cast("array<int>")
    c = c.withColumn("ocr_pages_", F.filter("pages_needing_ocr", lambda p: p < n))
    pages = F.col("ocr_pages_")
    unsure = F.col("confidence") < F.lit(cfg.min_confidence_32).cast("float")
    reason = F.when(unsure, "low_confidence").when(F.size(pages) == 0, "text_layer").when(F.size(pages) >= n, "scanned")
    reason = reason.otherwise("mixed_split" if cfg.split_pages else "mixed_unsplit")
    c = c.withColumn("reason", reason)
    tier = F.when(F.col("reason") == "low_confidence", "standard").when(F.col("reason") == "text_layer", "local").otherwise(ocr_tier(F.col("is_complex_layout"), cfg))
    c = c.withColumn("tier", tier).withColumn("routed_model", model_for(F.col("tier"), cfg))
    one = F.array(leg(F.col("routed_model"), F.col("tier"), whole))
    two = F.array(leg(F.lit(cfg.tiers.local), F.lit("local"), C.complement(pages, n)), leg(F.col("routed_model"), F.col("tier"), pages))
    c = c.withColumn("legs", F.when(F.col("reason") == "mixed_split", two).otherwise(one))
    return c.withColumn("is_split", F.size("legs") > 1).drop("ocr_pages_")


def bypass_model(default_model: Column, cfg: Config) -> Column:
    """The caller's default model, as it is, unless it is blank."""
    return F.coalesce(C.blank_to_null(default_model), F.lit(cfg.tiers.standard))


def decide(docs: DataFrame, cfg: Config, default_model: Column | None = None) -> DataFrame:
    """docs with kind (bypass or route) and the plan's columns. docs: what plan() needs, is_pdf, n_bytes, is_image, failed.

    Gates in order: declared an image, not a PDF, more bytes than allowed, no classification. A bypass goes as a whole to one model.
    """
    model = bypass_model(default_model if default_model is not None else F.lit(None).cast("string"), cfg)
    gate = F.when(F.col("is_image"), "image").when(~F.col("is_pdf"), "not_pdf").when(F.col("n_bytes") > cfg.max_document_bytes, "oversize").when(F.col("failed"), "classifier_unavailable")
    planned = plan(docs.withColumn("bypass_", gate), cfg)
    away = F.col("bypass_").isNotNull()
    planned = planned.withColumn("kind", F.when(away, "bypass").otherwise("route")).withColumn("reason", F.when(away, F.col("bypass_")).otherwise(F.col("reason")))
    planned = planned.withColumn("tier", F.when(away, BYPASS_TIER).otherwise(F.col("tier"))).withColumn("routed_model", F.when(away, model).otherwise(F.col("routed_model")))
    planned = planned.withColumn("legs", F.when(~away, F.col("legs"))).withColumn("is_split", F.when(~away, F.col("is_split")))
    return planned.drop("bypass_")


def metadata(decided: DataFrame) -> DataFrame:
    """The flat metadata of a decision; fields that a bypass lacks are null."""
    route = F.col("kind") == "route"
    only = lambda x: F.when(route, x)
    return decided.withColumn("metadata", F.struct(
        F.col("tier"), F.col("reason"), only(F.col("pdf_type")).alias("pdf_type"), only(F.col("confidence")).alias("confidence"), only(F.col("page_count")).alias("page_count"),
        only(F.col("pages_needing_ocr")).alias("pages_needing_ocr"), only(F.col("classify_ms")).alias("classify_ms"), F.col("routed_model"), F.col("legs"), F.col("is_split").alias("split"),
        F.lit(None).cast("string").alias("fallback_reason"),
    ))


def quoted(text: Column) -> Column:
    """A string as JSON."""
    value = F.to_json(F.array(text))
    return F.substring(value, F.lit(2), F.length(value) - 2)


def metadata_json(m: Column) -> Column:
    """Keys in their fixed order; null fields are left out, a leg's null pages stay."""
    numbers = lambda pages: F.concat(F.lit("["), F.array_join(pages.cast("array<string>"), ","), F.lit("]"))
    legs = F.transform(m["legs"], lambda x: F.concat(F.lit('{"model":'), quoted(x["model"]), F.lit(',"tier":'), quoted(x["tier"]), F.lit(',"pages":'), F.coalesce(numbers(x["pages"]), F.lit("null")), F.lit("}")))
    parts = [
        ("tier", quoted(m["tier"])), ("reason", quoted(m["reason"])), ("pdf_type", quoted(m["pdf_type"])), ("confidence", C.shortest(m["confidence"]).cast("string")), ("page_count", m["page_count"].cast("string")),
        ("pages_needing_ocr", numbers(m["pages_needing_ocr"])), ("classify_ms", m["classify_ms"].cast("string")), ("routed_model", quoted(m["routed_model"])),
        ("legs", F.concat(F.lit("["), F.array_join(legs, ","), F.lit("]"))), ("split", m["split"].cast("string")), ("fallback_reason", quoted(m["fallback_reason"])),
    ]
    written = [F.when(m["tier" if k == "routed_model" else k].isNotNull(), F.concat(F.lit(f'"{k}":'), v)) for k, v in parts]
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*written)), ","), F.lit("}"))
