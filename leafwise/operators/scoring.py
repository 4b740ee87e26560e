"""Scoring: verdicts against truth, and what follows from the four counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

COUNTS = ("correct_ocr", "correct_local", "missed_ocr", "wasted_ocr")


def score_pages(verdicts: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Per keys (doc_id by default) the four counts, the lists of missed, wasted and OCR pages, and whether the route is exact.

    verdicts: keys, page, needs_ocr; truth: doc_id, page of the pages that need OCR. One join on (doc_id, page), one aggregate.
    """
    keys = keys or ("doc_id",)
    marked = verdicts.join(truth.select("doc_id", "page", F.lit(True).alias("truly")), ["doc_id", "page"], "left").withColumn("truly", F.coalesce("truly", F.lit(False)))
    needs, truly = F.col("needs_ocr"), F.col("truly")
    pages = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("page"))))
    out = marked.groupBy(*keys).agg(
        F.count_if(needs & truly).alias("correct_ocr"), F.count_if(~needs & ~truly).alias("correct_local"), F.count_if(~needs & truly).alias("missed_ocr"), F.count_if(needs & ~truly).alias("wasted_ocr"),
        pages(~needs & truly).alias("missed_pages"), pages(needs & ~truly).alias("wasted_pages"), pages(needs).alias("ocr_pages"),
    )
    return out.withColumn("route_exact", (F.col("missed_ocr") == 0) & (F.col("wasted_ocr") == 0))


def score_lists(docs: DataFrame) -> DataFrame:
    """The same counts where each document has its pages as arrays: flagged, truth, page_count. No shuffle at all."""
    both = F.array_intersect("flagged", "truth")
    missed, wasted = F.array_except("truth", "flagged"), F.array_except("flagged", "truth")
    out = docs.withColumn("missed_pages", F.array_sort(missed)).withColumn("wasted_pages", F.array_sort(wasted)).withColumn("correct_ocr", F.size(both).cast("long"))
    out = out.withColumn("missed_ocr", F.size("missed_pages").cast("long")).withColumn("wasted_ocr", F.size("wasted_pages").cast("long"))
    out = out.withColumn("correct_local", F.col("page_count").cast("long") - F.col("correct_ocr") - F.col("missed_ocr") - F.col("wasted_ocr"))
    return out.withColumn("route_exact", (F.col("missed_ocr") == 0) & (F.col("wasted_ocr") == 0))


def add(scores: DataFrame, *keys: str) -> DataFrame:
    """Counts summed by keys, with the numbers of documents and of exact ones."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("documents"), F.count_if("route_exact").alias("exact"), *sums)


def pages() -> Column:
    return F.col("correct_ocr") + F.col("correct_local") + F.col("missed_ocr") + F.col("wasted_ocr")


def with_totals(scores: DataFrame) -> DataFrame:
    """pages, truly_needs_ocr, truly_local and is_perfect from the counts."""
    out = scores.withColumn("pages", pages()).withColumn("truly_needs_ocr", F.col("correct_ocr") + F.col("missed_ocr"))
    return out.withColumn("truly_local", F.col("correct_local") + F.col("wasted_ocr")).withColumn("is_perfect", (F.col("missed_ocr") == 0) & (F.col("wasted_ocr") == 0))


def with_rates(scores: DataFrame) -> DataFrame:
    """precision, recall and F1, null where they are not defined."""
    out = scores.withColumn("precision", C.ratio(F.col("correct_ocr"), F.col("correct_ocr") + F.col("wasted_ocr"))).withColumn("recall", C.ratio(F.col("correct_ocr"), F.col("correct_ocr") + F.col("missed_ocr")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p.isNull() | r.isNull(), F.lit(None).cast("double")).when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))


def with_cost(scores: DataFrame, price: float) -> DataFrame:
    """What the routing costs at a price a page, against OCR of all pages and against a router without error. Of summed counts, not a sum of costs."""
    cost = lambda n: n.cast("double") * F.lit(price)
    out = scores.withColumn("ocr_pages_n", F.col("correct_ocr") + F.col("wasted_ocr")).withColumn("ideal_ocr_pages", F.col("correct_ocr") + F.col("missed_ocr")).withColumn("all_pages", pages())
    out = out.withColumn("overspend_pages", F.col("wasted_ocr")).withColumn("underspend_pages", F.col("missed_ocr"))
    for name, n in (("overspend", "overspend_pages"), ("underspend", "underspend_pages"), ("naive", "all_pages"), ("routed", "ocr_pages_n"), ("ideal", "ideal_ocr_pages")):
        out = out.withColumn(name, cost(F.col(n)))
    out = out.withColumn("routed_share", C.ratio(F.col("ocr_pages_n"), F.col("all_pages"))).withColumn("saving", F.col("naive") - F.col("routed")).withColumn("ceiling_saving", F.col("naive") - F.col("ideal"))
    return out.withColumn("saving_beyond_ceiling_pages", (F.col("ideal_ocr_pages") - F.col("ocr_pages_n")).cast("long"))


def ceiling_verdict() -> Column:
    """Where a saving stands against the best a router can do: beyond (needed OCR was not bought), on it without error, on it by chance, short of it."""
    excess = F.col("saving_beyond_ceiling_pages")
    return F.when(excess > 0, "beyond").when(excess < 0, "short").when((F.col("underspend_pages") == 0) & (F.col("overspend_pages") == 0), "exact").otherwise("cancelled")


def token_usage(log: DataFrame, *keys: str) -> DataFrame:
    """Calls, calls that report tokens, and the tokens, of a log with input_tokens and output_tokens."""
    told = F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(told).alias("reporting"), F.sum(F.coalesce("input_tokens", F.lit(0))).cast("long").alias("input_tokens"), F.sum(F.coalesce("output_tokens", F.lit(0))).cast("long").alias("output_tokens"))


def with_spend(usage: DataFrame, per_million: float | None) -> DataFrame:
    """Whether all calls report, and the cost: 0 only for a complete count of no tokens, null without a price."""
    complete = F.col("calls") == F.col("reporting")
    price = F.lit(per_million).cast("double")
    return usage.withColumn("complete", complete).withColumn("judge_cost", F.when(complete & (F.col("input_tokens") == 0), F.lit(0.0)).otherwise(F.col("input_tokens").cast("double") / 1e6 * price))


def judge_state() -> Column:
    """How the judge's own cost is to be read."""
    return F.when(F.col("calls") == 0, "no_calls").when(F.col("reporting") == 0, "unreported").when(F.col("judge_cost").isNull(), "unpriced").when(F.col("complete"), "priced").otherwise("floor")


def latency(ms: DataFrame, *keys: str) -> DataFrame:
    """p50, p95 and max (nearest rank, 0 for none) and the number of documents, of rows with ms."""
    return ms.groupBy(*keys).agg(C.nearest_rank("ms", 0.5).alias("p50"), C.nearest_rank("ms", 0.95).alias("p95"), F.coalesce(F.max("ms"), F.lit(0.0)).alias("max"), F.count("ms").alias("documents"))


def confidences(verdicts: DataFrame) -> DataFrame:
    """(confidence, verdicts): distinct values and how often each occurs."""
    return verdicts.groupBy("confidence").agg(F.count(F.lit(1)).alias("verdicts"))


def reliability(judged: DataFrame) -> DataFrame:
    """Per tenth of confidence: verdicts, right ones, accuracy, mean confidence. judged: confidence (float), right. Empty where there
    are fewer than two distinct confidences."""
    tenths = judged.groupBy(C.bucket(F.col("confidence")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("verdicts"), F.count_if("right").alias("correct"), F.avg(F.col("confidence").cast("double")).alias("mean_confidence"),
    )
    spread = judged.agg(F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))
    return tenths.crossJoin(F.broadcast(spread)).where("lo <> hi").drop("lo", "hi").withColumn("accuracy", C.ratio(F.col("correct"), F.col("verdicts")))


def brier(judged: DataFrame) -> DataFrame:
    """(verdicts, distinct_confidences, degenerate, constant, brier): the Brier score, null where confidences don't differ."""
    gap = F.col("confidence").cast("double") - F.col("right").cast("double")
    out = judged.agg(F.count(F.lit(1)).alias("verdicts"), F.countDistinct("confidence").alias("distinct_confidences"), F.avg(gap * gap).alias("brier"), F.min("confidence").alias("low"))
    few = F.col("distinct_confidences") < 2
    return out.select("verdicts", "distinct_confidences", few.alias("degenerate"), F.when(F.col("distinct_confidences") == 1, F.col("low")).alias("constant"), F.when(~few, F.col("brier")).alias("brier"))
