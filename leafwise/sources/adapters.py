"""The driver's tables read as documents, pages, verdicts and call logs, with the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their line numbers as pages: one row a document, page lists as arrays. One shuffle of lineitem."""
    line = F.col("l_linenumber")
    returned = F.col("l_returnflag") == "R"
    why = F.when(F.col("l_quantity") > 25, "scan_like").otherwise("few_text_ops")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.max(line).alias("n"), F.collect_list(F.when(returned, line)).alias("raw"), F.collect_set(F.when(F.col("l_linestatus") == "F", line)).alias("raw_truth"),
        F.collect_set(F.when(returned & (F.col("l_discount") < 0.05), F.struct(line.alias("page"), why.alias("reason")))).alias("why"), F.max("l_discount").alias("discount"),
        F.bool_or(F.col("l_tax") >= 0.08).alias("complex"), F.bool_or(F.col("l_tax") == 0).alias("odd"),
    )
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("price")).join(lines, "doc_id", "left")
    docs = docs.withColumn("page_count", F.coalesce("n", F.lit(0)).cast("int"))
    raw = lambda name: F.coalesce(F.col(name), C.no_pages())
    reported = F.when(F.col("doc_id") % 3 == 0, "scanned").when(F.col("doc_id") % 3 == 1, "image_based").otherwise("mixed")
    reasons = F.transform(F.array_sort("why"), lambda r: F.struct((r["page"] - 1).cast("int").alias("page"), F.array(r["reason"]).alias("reasons")))
    return docs.select(
        "doc_id", "source", "price", "page_count", raw("raw").alias("raw_pages"), C.normalize_pages(raw("raw"), F.col("page_count")).alias("flagged"), C.normalize_pages(raw("raw_truth"), F.col("page_count")).alias("truth"),
        (F.lit(1.0) - 5 * F.coalesce("discount", F.lit(0.0))).cast("float").alias("confidence"), F.coalesce("complex", F.lit(False)).alias("is_complex_layout"), F.coalesce("odd", F.lit(False)).alias("has_encoding_issues"),
        reported.alias("reported"), F.coalesce(reasons, F.array().cast("array<struct<page:int,reasons:array<string>>>")).alias("reasons"),
    )


LINE_DOCS = """
docs AS (
  SELECT o_orderkey AS doc_id, o_orderpriority AS source, o_totalprice AS price, coalesce(max(l_linenumber), 0)::INTEGER AS page_count,
    coalesce(list_sort(list(DISTINCT (l_linenumber - 1)::INTEGER) FILTER (l_returnflag = 'R')), []::INTEGER[]) AS flagged,
    coalesce(list_sort(list(DISTINCT (l_linenumber - 1)::INTEGER) FILTER (l_linestatus = 'F')), []::INTEGER[]) AS truth,
    (1.0::DOUBLE - 5 * coalesce(max(l_discount), 0.0))::FLOAT AS confidence, coalesce(bool_or(l_tax >= 0.08), false) AS is_complex, coalesce(bool_or(l_tax = 0), false) AS odd,
    CASE o_orderkey % 3 WHEN 0 THEN 'scanned' WHEN 1 THEN 'image_based' ELSE 'mixed' END AS reported
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority, o_totalprice)
"""
#: (doc_id, source, page, flagged, truly): one row a page.
LINE_PAGES = LINE_DOCS + """,
pgs AS (SELECT doc_id, source, t.page::INTEGER AS page, list_contains(flagged, t.page) AS flagged, list_contains(truth, t.page) AS truly FROM docs, unnest(range(0, page_count)) AS t(page))
"""
#: The least reason of each page that has one.
LINE_REASONS = """
why AS (SELECT l_orderkey AS doc_id, (l_linenumber - 1)::INTEGER AS page, min(CASE WHEN l_quantity > 25 THEN 'scan_like' ELSE 'few_text_ops' END) AS reason
  FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.05 GROUP BY ALL)
"""


def line_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.evidence import evidence

    none = C.no_pages()
    return evidence(line_docs(spark, sf_dir).withColumn("tables", none).withColumn("columns", none))


def line_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_docs(spark, sf_dir).select("doc_id", F.explode("truth").alias("page"))


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text", "role")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a call log: the user is the judge, `error` a failed call, value the time, k of props the tokens; small values report none."""
    e = table(spark, sf_dir, "events")
    tokens = F.when(F.col("value") >= 10, F.get_json_object("props", "$.k").cast("long"))
    return e.select(F.col("user_id").alias("judge"), F.col("event_id").alias("call_no"), F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))").alias("ts_ms"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("kind"), F.col("value").alias("ms"), tokens.alias("input_tokens"), F.lit(None).cast("long").alias("output_tokens"))


EVENT_LOG = """
log AS (SELECT user_id AS judge, event_id AS call_no, (epoch_us(ts) // 1000)::BIGINT AS ts_ms, event_type <> 'error' AS ok, event_type AS kind, value AS ms,
  CASE WHEN value >= 10 THEN json_extract_string(props, '$.k')::BIGINT END AS input_tokens FROM events)
"""


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hosted judge's answers, replayed: the first line of a page says how sure it is; every 50th page has no usable answer."""
    line = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("page")).agg(F.max("l_discount").alias("d"), F.min("l_quantity").alias("q"))
    lost = (F.col("doc_id") + F.col("page")) % 50 == 0
    return line.select("doc_id", "page", F.when(~lost, (F.col("d") * 10)).alias("probability"), F.when(lost, F.when(F.col("q") > 25, "timeout").otherwise("http")).alias("failure"))


PROBABILITIES = """
ans AS (SELECT l_orderkey AS doc_id, (l_linenumber - 1)::INTEGER AS page, CASE WHEN (l_orderkey + l_linenumber - 1) % 50 <> 0 THEN max(l_discount) * 10 END AS probability,
  CASE WHEN (l_orderkey + l_linenumber - 1) % 50 = 0 THEN CASE WHEN min(l_quantity) > 25 THEN 'timeout' ELSE 'http' END END AS failure FROM lineitem GROUP BY l_orderkey, l_linenumber)
"""
