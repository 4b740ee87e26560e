"""Command line: classify, plan, extract, split, run and bench.

    python -m leafwise.cli plan FILE... [--config FILE] [--judge NAME] [--json]
"""

from __future__ import annotations

import argparse
import functools
import json
import os
import sys
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from . import config as conf
from .functions import columns as C
from .operators import bench, hosted, judges, policy, report
from .plans.lineage import kept
from .sources import corpus


def session() -> SparkSession:
    return SparkSession.builder.appName("leafwise").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def http_host(base_url: str, key: str | None, timeout: float | None):
    """An OCR host behind HTTP: POST /v1/ocr with the model, the document in Base64 and, for a subset, its pages."""

    def call(model, content, pages):
        import base64

        body = {"model": model, "document": {"type": "document_url", "document_url": "data:application/pdf;base64," + base64.b64encode(bytes(content)).decode()}}
        if pages is not None:
            body["pages"] = pages
        request = urllib.request.Request(base_url.rstrip("/") + "/v1/ocr", json.dumps(body).encode(), {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {}))
        with urllib.request.urlopen(request, timeout=timeout if timeout and timeout > 0 else None) as answer:
            got = json.loads(answer.read())
        return {**got, **(got.get("usage_info") or {})}

    return call


def _bench(spark: SparkSession, args) -> int:
    ready = hosted.from_environment(dict(os.environ), base_url=args.judge_url, key=args.judge_key)
    names, skipped = bench.judge_list(args.judge or [], judges.registry("ready" if ready else None))
    manifest = corpus.load_manifest(spark, args.corpus)
    found, failures = corpus.with_contents(manifest, corpus.read_files(spark, args.files or str(Path(args.corpus).parent)))
    docs = found.withColumn("doc_id", F.col("seq").cast("long"))
    verdicts, times, usage, wrong = [], [], [spark.createDataFrame([], "judge string, input_tokens long, output_tokens long")], []
    for name in names:
        runs = []
        for run_no in range(args.repeat):
            judge = hosted.by_name(name, ready)
            classified, told = (kept(df, "bench") for df in api.judged(docs.select("doc_id", "content"), None, judge))
            ms = classified.select("doc_id", F.col("classify_ms").alias("ms"))
            if isinstance(judge, hosted.Hosted):
                calls = judge.usage()
                spent = calls.groupBy("doc_id").agg(F.sum("elapsed_ms").alias("call_ms"))
                ms = ms.join(spent, "doc_id", "left").select("doc_id", (F.col("ms") + F.coalesce("call_ms", F.lit(0))).alias("ms"))
            runs.append(ms.select(F.lit(name).alias("judge"), "doc_id", F.lit(run_no).alias("run_no"), "ms", F.lit(run_no).alias("verdict")))
        # Verdicts and calls are those of the last run, times the medians of all.
        if isinstance(judge, hosted.Hosted):
            usage.append(judge.usage().select("judge", "input_tokens", "output_tokens"))
        times.append(bench.repeats(functools.reduce(DataFrame.unionByName, runs), "judge", "doc_id").drop("verdict"))
        verdicts.append(told.select(F.lit(name).alias("judge"), "doc_id", "page", "needs_ocr", "confidence"))
        wrong.append(bench.count_mismatch(docs, classified).select("doc_id", F.lit("page count differs").alias("error"), F.lit(None).cast("string").alias("judge")))
        wrong.append(classified.where("failed").select("doc_id", F.lit("no verdict for each page").alias("error"), F.lit(name).alias("judge")))
    wrong, *rest = (functools.reduce(DataFrame.unionByName, x) for x in (wrong, verdicts, times, usage))
    wrong = kept(wrong.groupBy("doc_id").agg(F.min(F.struct("error", "judge")).alias("e")), "bench-wrong")
    lost = [r.asDict() for r in failures.withColumn("judge", F.lit(None).cast("string")).unionByName(docs.join(wrong, "doc_id").select(F.col("label").alias("document"), "e.error", "e.judge")).collect()]
    total, docs = manifest.count(), bench.exclude(docs, wrong)
    good = docs.select("doc_id")
    verdicts, times, usage = rest[0].join(good, "doc_id"), rest[1].join(good, "doc_id"), rest[2]
    truth = docs.select("doc_id", F.explode("needs_ocr").alias("page"))
    got = report.rows(report.relations(verdicts, docs, truth, times, usage, price=args.cost_per_page, per_million=args.cost_per_million_input_tokens))
    head = {"corpus": args.corpus, "documents": total, "scored": docs.count(), "repeat": args.repeat, "cost_per_page": args.cost_per_page, "cost_per_million_input_tokens": args.cost_per_million_input_tokens}
    print(corpus.write_report({**head, "judges": names, "skipped": skipped, "failures": lost, **got}, args.out, args.json, report.render(got, skipped, lost, head)))
    return int(bool(lost))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="leafwise")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("classify", "plan", "extract", "split", "run"):
        p = sub.add_parser(name)
        p.add_argument("files", nargs="+")
        p.add_argument("--config")
        p.add_argument("--json", action="store_true")
        p.add_argument("--judge", default="heuristic")
        p.add_argument("--pages", help="0-based, as 0,2,5")
        p.add_argument("--out")
        p.add_argument("--base-url", default="http://localhost:4000")
        p.add_argument("--api-key")
        p.add_argument("--default-model")
        p.add_argument("--split-subset", action="store_true")
        p.add_argument("--judge-url")
        p.add_argument("--judge-key")
    p = sub.add_parser("bench")
    p.add_argument("--repeat", type=int, default=1)
    p.add_argument("--judge-url")
    p.add_argument("--judge-key")
    p.add_argument("--corpus", required=True)
    p.add_argument("--files")
    p.add_argument("--judge", action="append")
    p.add_argument("--cost-per-page", type=float, default=1.0)
    p.add_argument("--cost-per-million-input-tokens", type=float)
    p.add_argument("--json", action="store_true")
    p.add_argument("--out")
    args = parser.parse_args(argv)
    corpus.load_env(".env")
    key = corpus.api_key(getattr(args, "api_key", None), dict(os.environ))
    pages = [int(x) for x in args.pages.split(",")] if getattr(args, "pages", None) else None
    if args.command == "split":
        Path(args.out or "split.pdf").write_bytes(api.split(Path(args.files[0]).read_bytes(), pages or []))
        return 0
    spark = session()
    if args.command == "bench":
        return _bench(spark, args)
    cfg = conf.load(args.config)
    # Before any call that costs money: an unknown judge, or one that can't be used here, is an error.
    judge = hosted.by_name(args.judge, hosted.from_environment(dict(os.environ), base_url=args.judge_url, key=args.judge_key))
    files = api.from_paths(spark, args.files)
    content = files.select("doc_id", "content")
    if args.command == "classify":
        out = api.classify(content, cfg, judge)
        line = F.format_string("%s (confidence %.2f), %d page(s), %d needing OCR %s, %s", "pdf_type", F.col("confidence").cast("double"), "page_count", F.size("pages_needing_ocr"), C.format_pages(F.col("pages_needing_ocr")), F.when(F.col("is_complex_layout"), "complex layout").otherwise("simple layout"))
        out = out.withColumn("line", line)
    elif args.command == "plan":
        out = api.decide(content, cfg, judge, args.default_model).select("doc_id", "kind", policy.metadata_json(F.col("metadata")).alias("metadata"))
    elif args.command == "extract":
        out = api.extract_local(content, pages, cfg)
        if args.out:
            out = corpus.write_pages(out.select("doc_id", F.col("page").alias("index"), F.col("text").alias("markdown")), args.out)
    else:
        merged, docs = api.run(content, http_host(args.base_url, key, cfg.fetch_timeout_seconds), cfg, judge, args.default_model, split_subset=args.split_subset)
        merged, docs = kept(merged, "pages"), kept(docs, "documents")
        if args.out:
            api.payload(merged, docs).write.json(args.out)
        out = docs.join(merged.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.min_by(C.preview(F.col("markdown")), "at").alias("preview")), "doc_id", "left")
    for row in out.orderBy("doc_id").toLocalIterator():
        values = row.asDict(recursive=True)
        if args.command == "plan":
            values["metadata"] = json.loads(values["metadata"])
        print(json.dumps(values, default=str) if args.json or "line" not in values else f"{args.files[values['doc_id']]}: {values['line']}")
    return 0


__all__ = ["http_host", "main"]

if __name__ == "__main__":
    sys.exit(main())
