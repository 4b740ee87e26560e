"""The router as Python functions: documents in, classification, plan, result and metadata out, over any number of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FAILURES, Config, ConfigError, defaults, from_dict
from .functions import columns as C
from .operators import evidence, execution, judges, policy
from .sources import pdf as P
from .sources.pdf import PdfError, is_pdf, split

__all__ = ["Config", "ConfigError", "HostError", "LegFailed", "PdfError", "classify", "decide", "defaults", "extract_local", "is_pdf", "merge", "plan_route", "remap_pages", "run", "split", "validate_config"]


class HostError(RuntimeError):
    """An OCR host that failed."""


class LegFailed(RuntimeError):
    """A leg, and the retry after it, that failed."""


def validate_config(values: dict) -> dict:
    return from_dict(values).as_dict()


def analysed(files: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(documents with flags as arrays, (doc_id, page, text)) of (doc_id, content)."""
    docs = P.documents(files, cfg.max_document_bytes).withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    flag = lambda p: C.inspector_flag(p["text_ops"], p["image_pixels"], p["alnum_kinds"], p["vector_text"], p["bad_fonts"])
    listed = lambda cond: F.coalesce(F.transform(F.filter("pages", cond), lambda p: p["page"]), C.no_pages())
    docs = docs.withColumn("flagged", listed(flag)).withColumn("tables", listed(lambda p: p["tables"])).withColumn("columns", listed(lambda p: p["columns"]))
    reasons = F.transform(F.filter("pages", flag), lambda p: F.struct(p["page"].alias("page"), F.array(F.when(p["bad_fonts"], "bad_font").when(p["vector_text"], "vector_text").when(p["text_ops"] < 3, "no_text").otherwise("template_image")).alias("reasons")))
    docs = docs.withColumn("reasons", F.coalesce(reasons, F.array().cast("array<struct<page:int,reasons:array<string>>>")))
    odd = F.exists("pages", lambda p: p["bad_fonts"])
    docs = docs.withColumn("has_encoding_issues", F.coalesce(odd, F.lit(False)))
    texts = docs.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.page", "p.text")
    return docs, texts


def classify(files: DataFrame, cfg: Config | None = None, judge: judges.Judge | None = None) -> DataFrame:
    """A row per file: is_pdf, n_bytes, failed, page_count, pdf_type, confidence, pages_needing_ocr, is_complex_layout, has_encoding_issues, reasons.
    A document is failed if it can't be read, or if the judge gave other verdicts than one for each of its pages."""
    return judged(files, cfg, judge)[0]


def judged(files: DataFrame, cfg: Config | None = None, judge: judges.Judge | None = None) -> tuple[DataFrame, DataFrame]:
    """(what classify gives, the verdicts it rests on)."""
    cfg, judge = cfg or Config(), judge or judges.Heuristic()
    docs, texts = analysed(files, cfg)
    pages = evidence.evidence(docs, texts if judge.needs_text else None)
    n = F.col("page_count")
    text_kinds = F.exists("pages", lambda p: p["text_ops"] > 0)
    docs = docs.withColumn("reported", F.when((n > 0) & text_kinds, "image_based").otherwise("scanned"))
    share = C.ratio(n - F.size("flagged"), n)
    label = C.label(F.col("reported"), F.col("flagged"), n)
    docs = docs.withColumn("confidence", F.when(n == 0, F.lit(0.9).cast("float")).otherwise(C.document_confidence(label, share)))
    verdicts = judge.judge(pages)
    out = evidence.classify(docs, verdicts)
    # Where the label says scan or image, the layout pass is left out.
    skip = evidence.skips_analysis(F.col("reported"), F.col("flagged"), n)
    complex_ = ~skip & ((F.size("tables") > 0) | (F.size("columns") > 0))
    out = out.withColumn("is_complex_layout", complex_).withColumn("failed", F.col("error").isNotNull() | (F.col("contract") != "ok")).withColumn("is_image", F.lit(False)).withColumn("classify_ms", F.coalesce("classify_ms", F.lit(0.0))).drop("pages", "flagged", "tables", "columns", "reported", "error", "contract")
    return out, verdicts


def plan_route(classified: DataFrame, cfg: Config | None = None) -> DataFrame:
    """The plan of a classification, our own or one from outside that leaves fields out."""
    return policy.plan(evidence.with_defaults(classified), cfg or Config())


def decide(files: DataFrame, cfg: Config | None = None, judge: judges.Judge | None = None, default_model: str | None = None) -> DataFrame:
    """Classification, decision and metadata of each file; never an error."""
    return decided_with_verdicts(files, cfg, judge, default_model)[0]


def decided_with_verdicts(files: DataFrame, cfg: Config | None = None, judge: judges.Judge | None = None, default_model: str | None = None) -> tuple[DataFrame, DataFrame]:
    classified, verdicts = judged(files, cfg, judge)
    return policy.metadata(policy.decide(classified, cfg or Config(), F.lit(default_model).cast("string"))), verdicts


def extract_local(files: DataFrame, pages: list[int] | None = None, cfg: Config | None = None) -> DataFrame:
    """(doc_id, page, text): the text layer of some pages, or of all."""
    _, texts = analysed(files, cfg or Config())
    return texts if pages is None else texts.where(F.col("page").isin(*pages))


remap_pages, merge = execution.remap, (execution.merged_pages, execution.merged_summary)


def run(files: DataFrame, host: execution.Host, cfg: Config | None = None, judge: judges.Judge | None = None, default_model: str | None = None, *, split_subset: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, documents): pages merged in order; documents with their decision, the fallback and, where the retry failed too, the error."""
    from .plans.lineage import kept

    cfg = cfg or Config()
    decided, verdicts = (kept(df, tag) for df, tag in zip(decided_with_verdicts(files, cfg, judge, default_model), ("decided", "verdicts"), strict=True))
    _, texts = analysed(files, cfg)
    rows = execution.legs(decided)
    contents = files.select("doc_id", "content")
    done = kept(execution.local(rows, texts).unionByName(execution.hosted(rows, contents, host, split_subset=split_subset)), "results")
    again = kept(execution.hosted(execution.needs_retry(decided, done, cfg, default_model), contents, host), "retries")
    results, outcome = execution.with_fallback(decided, done, again)
    both = decided.drop("routed_model").join(outcome, "doc_id")
    fell_back = verdicts.where(F.col("reason").isin(*FAILURES.values())).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("pages"))
    told = fell_back.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("reason", "pages"))).alias("fallbacks"))
    docs = both.join(execution.merged_summary(results), "doc_id", "left").join(told, "doc_id", "left")
    name = (judge or judges.Heuristic()).name
    provenance = F.struct(F.lit(name).alias("name"), F.coalesce("fallbacks", F.array().cast("array<struct<reason:string,pages:bigint>>")).alias("fallbacks"))
    return execution.merged_pages(results), docs.withColumn("judge", provenance).drop("fallbacks")


def payload(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, result, metadata, judge, error): a run as one record a document, for a sink."""
    page = F.struct("at", "index", "markdown", "model")
    listed = pages.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(page)), lambda p: p.dropFields("at")).alias("pages"))
    both = docs.join(listed, "doc_id", "left")
    result = F.struct(F.coalesce("pages", F.array().cast("array<struct<index:int,markdown:string,model:string>>")).alias("pages"), F.col("model"), F.col("pages_processed"), F.col("doc_size_bytes"))
    metadata = F.col("metadata").withField("fallback_reason", F.col("fallback_reason")).withField("routed_model", F.col("routed_model"))
    return both.select("doc_id", result.alias("result"), metadata.alias("metadata"), "judge", "error")


def from_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, path, content) of files, numbered in the order of their paths; the list is the caller's and short."""
    raw = spark.read.format("binaryFile").load(paths)
    names = spark.createDataFrame([(i, p.rpartition("/")[2]) for i, p in enumerate(paths)], "doc_id long, name string")
    return raw.withColumn("name", C.base_name(F.col("path"))).join(F.broadcast(names), "name").select("doc_id", "path", "content")
