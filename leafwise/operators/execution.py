"""Running plans: legs as rows, hosts behind a function, one fallback, merging in page order."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import columns as C

PAGE = "struct<index:int,markdown:string>"
RESULT = f"doc_id long, leg_no int, model string, pages array<{PAGE}>, pages_processed int, doc_size_bytes long, error string"
#: (model, content, pages or None) -> {"pages": [{"index", "markdown"}], "model", "pages_processed", "doc_size_bytes"}; raises on failure.
Host = Callable[[str, Any, list[int] | None], dict]


def legs(planned: DataFrame, *keep: str) -> DataFrame:
    """(doc_id, leg_no, model, tier, pages, is_local, kept columns), a row per leg; bypassed documents get one leg on their model."""
    whole = F.array(F.struct(F.col("routed_model").alias("model"), F.col("tier").alias("tier"), F.lit(None).cast("array<int>").alias("pages")))
    rows = planned.select("doc_id", F.posexplode(F.coalesce("legs", whole)).alias("leg_no", "leg"), *keep)
    return rows.select("doc_id", "leg_no", "leg.model", "leg.tier", "leg.pages", (F.col("leg.tier") == "local").alias("is_local"), *keep)


def local(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Results of local legs: the text layer of the leg's pages, or of all. texts: (doc_id, page, text); pages without text are empty."""
    picked = rows.where("is_local").join(texts, "doc_id", "left").where(F.col("pages").isNull() | F.array_contains("pages", F.col("page")))
    out = picked.groupBy("doc_id", "leg_no", "model").agg(F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), F.struct(F.col("page").cast("int").alias("index"), F.coalesce("text", F.lit("")).alias("markdown"))))).alias("pages"))
    return out.select("doc_id", "leg_no", "model", F.col("pages").cast(f"array<{PAGE}>").alias("pages"), F.size("pages").alias("pages_processed"), F.lit(None).cast("long").alias("doc_size_bytes"), F.lit(None).cast("string").alias("error"))


def hosted(rows: DataFrame, contents: DataFrame, host: Host, *, split_subset: bool = False) -> DataFrame:
    """Results of other legs, by a host called in the tasks. contents: (doc_id, content). A failure becomes a row with an error. With split_subset
    the host gets a file of the leg's pages and no page list, and its pages are numbered back."""

    def run(frames):
        import pandas as pd

        from ..sources.pdf import split

        for pdf in frames:
            out = []
            for doc_id, leg_no, model, pages, content in zip(pdf["doc_id"], pdf["leg_no"], pdf["model"], pdf["pages"], pdf["content"], strict=True):
                wanted = None if pages is None else [int(p) for p in pages]
                try:
                    apart = split_subset and wanted is not None
                    got = host(model, split(bytes(content), wanted), None) if apart else host(model, content, wanted)
                    found = [{"index": int(p.get("index", i) if p.get("index") is not None else i), "markdown": p.get("markdown") or ""} for i, p in enumerate(got.get("pages") or [])]
                    if apart:
                        found = [{**p, "index": wanted[p["index"]] if p["index"] < len(wanted) else p["index"]} for p in found]
                    processed = got.get("pages_processed")
                    out.append((doc_id, leg_no, (got.get("model") or "").strip() and got["model"] or model, found, len(found) if processed is None else processed, got.get("doc_size_bytes"), None))
                except Exception as e:  # noqa: BLE001  a host's failure is a result here
                    out.append((doc_id, leg_no, model, [], 0, None, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(out, columns=["doc_id", "leg_no", "model", "pages", "pages_processed", "doc_size_bytes", "error"])

    return rows.where("NOT is_local").join(contents, "doc_id").select("doc_id", "leg_no", "model", "pages", "content").mapInPandas(run, RESULT)


def with_fallback(planned: DataFrame, results: DataFrame, retried: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, documents): of documents with a failed leg, their whole-document retry takes the place of all legs.

    retried: results of such documents on the fallback model. documents: doc_id, fallback_reason, routed_model, error (if the retry failed too). A bypass has
    no retry: leave its documents out of retried. The tables have a row per document or more and are written compressed, from which Spark takes them
    for small; so their joins are merged and never broadcast.
    """
    failed = results.where("error IS NOT NULL").groupBy("doc_id").agg(F.min_by("error", "leg_no").alias("first_error")).hint("merge")
    kept = results.join(failed, "doc_id", "left_anti").unionByName(retried.where("error IS NULL").join(failed.select("doc_id"), "doc_id", "left_semi"))
    second = retried.select("doc_id", F.col("model").alias("second_model"), F.col("error").alias("second_error"), F.lit(True).alias("tried")).hint("merge")
    docs = planned.select("doc_id", "routed_model").join(failed, "doc_id", "left").join(second, "doc_id", "left")
    saved = F.col("first_error").isNotNull() & F.coalesce("tried", F.lit(False)) & F.col("second_error").isNull()
    lost = F.when(F.col("first_error").isNotNull() & ~saved, F.concat(F.coalesce("second_error", F.lit("no retry")), F.lit(" (after "), F.col("first_error"), F.lit(")")))
    return kept, docs.select("doc_id", F.when(saved, "leg_failed").alias("fallback_reason"), F.when(saved, F.col("second_model")).otherwise(F.col("routed_model")).alias("routed_model"), lost.alias("error"))


def needs_retry(planned: DataFrame, results: DataFrame, cfg: Config, default_model: str | None = None, *keep: str) -> DataFrame:
    """Legs for the retry, with kept columns of planned: the whole document on the default model, unless that is blank, else on the standard one; only for
    routed documents. The join is merged, as in with_fallback."""
    routed = planned.where("kind = 'route'").select("doc_id", *keep).hint("merge")
    failed = results.where("error IS NOT NULL").select("doc_id").distinct().join(routed, "doc_id", "inner" if keep else "left_semi")
    model = default_model if default_model and default_model.strip() else cfg.tiers.standard
    return failed.select("doc_id", F.lit(0).alias("leg_no"), F.lit(model).alias("model"), F.lit("standard").alias("tier"), F.lit(None).cast("array<int>").alias("pages"), F.lit(False).alias("is_local"), *keep)


def remap(index: Column, pages: Column) -> Column:
    """A subset's page number to the document's; beyond the list it stays."""
    return F.coalesce(F.get(pages, index), index)


def merged_pages(results: DataFrame) -> DataFrame:
    """(doc_id, at, index, markdown, model): pages of all legs in order of index, then leg, then place; duplicates stay."""
    rows = results.select("doc_id", "leg_no", "model", F.posexplode("pages").alias("pos", "p"))
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("p.index", "leg_no", "pos")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("at"), F.col("p.index").alias("index"), F.col("p.markdown").alias("markdown"), "model")


def merged_summary(results: DataFrame) -> DataFrame:
    """(doc_id, model, pages_processed, doc_size_bytes): models joined in leg order, pages summed, the largest size that is known."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("leg_no", "model"))), lambda x: x["model"])
    return results.groupBy("doc_id").agg(F.array_join(names, ",").alias("model"), F.sum("pages_processed").cast("long").alias("pages_processed"), F.max("doc_size_bytes").alias("doc_size_bytes"))


def leg_timing(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with elapsed_ms of the earliest call for the same document, model and pages; null for legs run in process."""
    key = lambda pages: F.coalesce(F.array_join(pages.cast("array<string>"), ","), F.lit("all"))
    first = log.groupBy("doc_id", "model", key(F.col("pages")).alias("on")).agg(F.min_by("elapsed_ms", "call_no").alias("elapsed_ms"))
    return rows.withColumn("on", key(F.col("pages"))).join(first, ["doc_id", "model", "on"], "left").drop("on")


def request_body(rows: DataFrame) -> Column:
    """A request as JSON: pages only for a subset. rows: model, content, pages."""
    return F.to_json(F.struct("model", F.struct(F.lit("document_url").alias("type"), F.concat(F.lit("data:application/pdf;base64,"), F.regexp_replace(F.base64("content"), "\r\n", "")).alias("document_url")).alias("document"), "pages"))


def response(text: Column, requested: Column) -> Column:
    """A host's JSON answer as a struct: blank model is the requested one, missing counts are the number of pages, missing text is empty, a missing index is its place."""
    raw = F.from_json(text, "pages ARRAY<STRUCT<index INT, markdown STRING>>, model STRING, usage_info STRUCT<pages_processed INT, doc_size_bytes BIGINT>")
    pages = F.transform(F.coalesce(raw["pages"], F.array().cast("array<struct<index:int,markdown:string>>")), lambda p, i: F.struct(F.coalesce(p["index"], i).alias("index"), F.coalesce(p["markdown"], F.lit("")).alias("markdown")))
    return F.struct(F.coalesce(C.blank_to_null(raw["model"]), requested).alias("model"), pages.alias("pages"), F.coalesce(raw["usage_info"]["pages_processed"], F.size(pages)).alias("pages_processed"), raw["usage_info"]["doc_size_bytes"].alias("doc_size_bytes"))


def leg_tier(tier: Column, model: Column, cfg: Config) -> Column:
    """A leg's tier where it is left out: local for the local model, else standard."""
    return F.coalesce(tier, F.when(model == cfg.tiers.local, "local").otherwise("standard"))


def error_class(kind: Column, inner: Column) -> Column:
    """config, pdf or host; a failed leg has the class of what failed it."""
    own = lambda k: F.when(k == "config", "config").when(k.isin("not_pdf", "parse", "page_range"), "pdf").otherwise("host")
    return F.when(kind == "leg_failed", own(inner)).otherwise(own(kind))
