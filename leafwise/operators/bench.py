"""Judges against each other: exclusion, reconciliation, grouping, caveats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scoring

BASELINE = "heuristic"


def judge_list(names: list[str], known: dict[str, str]) -> tuple[list[str], list[tuple[str, str]]]:
    """(judges to run, skipped with the reason): the baseline first, each once; an unknown name is an error."""
    run, skipped = [], []
    for name in dict.fromkeys([BASELINE, *names]):
        if name not in known:
            raise KeyError(f"no judge is named {name}; there are {', '.join(known)}")
        if known[name] == "ready":
            run.append(name)
        else:
            skipped.append((name, known[name]))
    return run, skipped


def every_judge(docs: DataFrame, judges: DataFrame) -> DataFrame:
    """Each judge on each document. judges is a list of a few names, given by the caller."""
    return docs.crossJoin(F.broadcast(judges))


def exclude(rows: DataFrame, failures: DataFrame) -> DataFrame:
    """rows without the documents that any judge failed on."""
    return rows.join(failures.select("doc_id").distinct(), "doc_id", "left_anti")


def count_mismatch(manifest: DataFrame, classified: DataFrame) -> DataFrame:
    """(doc_id, expected, found): documents whose number of pages is not the manifest's."""
    both = manifest.select("doc_id", F.col("page_count").alias("expected")).join(classified.select("doc_id", F.col("page_count").alias("found")), "doc_id")
    return both.where("expected <> found")


def inconsistent(classified: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(doc_id, verdicts, page_count, routed): documents whose verdicts are not one a page, or route other pages than the classification."""
    own = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("verdicts"), F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page")))).alias("routed"))
    both = classified.select("doc_id", "page_count", "pages_needing_ocr").join(own, "doc_id", "left")
    both = both.withColumn("verdicts", F.coalesce("verdicts", F.lit(0))).withColumn("routed", F.coalesce("routed", F.array().cast("array<int>")))
    return both.where((F.col("verdicts") != F.col("page_count")) | (F.array_join(F.col("routed").cast("array<string>"), ",") != F.array_join(F.col("pages_needing_ocr").cast("array<string>"), ",")))


def repeats(runs: DataFrame, *keys: str) -> DataFrame:
    """Median time of the repeats, and the verdict of the last. runs: keys, run_no, ms, verdict."""
    return runs.groupBy(*keys).agg(F.coalesce(F.median("ms"), F.lit(0.0)).alias("ms"), F.max_by("verdict", "run_no").alias("verdict"))


def with_delta(times: DataFrame, baseline: str = BASELINE) -> DataFrame:
    """times (judge, doc_id, ms) with the difference to the baseline's; null for the baseline itself."""
    base = times.where(F.col("judge") == baseline).select("doc_id", F.col("ms").alias("base_ms"))
    return times.join(base, "doc_id", "left").withColumn("delta_ms", F.when(F.col("judge") != baseline, F.col("ms") - F.col("base_ms"))).drop("base_ms")


def overhead(deltas: DataFrame) -> DataFrame:
    """(judge, overhead_ms): the median difference; null for the baseline."""
    return deltas.groupBy("judge").agg(F.median("delta_ms").alias("overhead_ms"))


def by_source(scores: DataFrame, *keys: str) -> DataFrame:
    """Counts by keys and source, and over all sources (source null), in one pass. seq gives the sources their order."""
    sums = [F.sum(c).alias(c) for c in scoring.COUNTS]
    out = scores.rollup(*keys, "source") if not keys else scores.groupingSets([[*keys, "source"], list(keys)], *keys, "source")
    return out.agg(F.count(F.lit(1)).alias("documents"), F.count_if("route_exact").alias("exact"), *sums)


def first_seen(rows: DataFrame, name: str = "source", seq: str = "seq") -> DataFrame:
    """(name, at): distinct values in the order in which they were first seen."""
    return rows.groupBy(name).agg(F.min(seq).alias("first")).withColumn("at", F.row_number().over(Window.orderBy("first"))).select(name, "at")


def synthetic_caveats(groups: DataFrame) -> DataFrame:
    """(judge, source, documents, pages): perfect groups of synthetic documents, which tell nothing about a judge."""
    totals = scoring.with_totals(groups)
    return totals.where("lower(source) = 'synthetic' AND is_perfect AND pages > 0").select("judge", "source", "documents", "pages")


def group_line() -> Column:
    """A group in one line."""
    return F.format_string("%s: %d document(s), %d page(s), %d missed, %d wasted, %d/%d exact", F.col("source"), F.col("documents"), scoring.pages(), F.col("missed_ocr"), F.col("wasted_ocr"), F.col("exact"), F.col("documents"))
