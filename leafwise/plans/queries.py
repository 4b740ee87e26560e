"""Every query over the driver's tables, with its SQL. Page lists are joined to strings, so that they compare alike everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ASKED_CLEAR, ASKED_NEEDS, FAILURES, GATED_REASON, JUDGES, VARIANTS, Config, Models
from ..functions import columns as C
from ..operators import bench, evidence, execution, judges, policy, scoring
from ..sources import adapters as A
from .lineage import kept
from .registry import query

PRICE, PER_MILLION = 0.002, 0.042
FAILED_REASONS = tuple(FAILURES.values())
HOSTED = JUDGES[1]
DOCS, PAGES = f"WITH {A.LINE_DOCS.strip()}\n", f"WITH {A.LINE_PAGES.strip()}\n"
LABEL = "CASE WHEN page_count = 0 THEN reported WHEN len(flagged) = 0 THEN 'text_based' WHEN len(flagged) >= page_count THEN reported ELSE 'mixed' END"


def _s(pages: Column | str) -> Column:
    pages = F.col(pages) if isinstance(pages, str) else pages
    return F.array_join(pages.cast("array<string>"), ",")


def _j(name: str) -> str:
    return f"array_to_string({name}, ',')"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.line_docs(spark, sf_dir)
    return d.withColumn("pages_needing_ocr", F.col("flagged")).withColumn("pdf_type", C.label(F.col("reported"), F.col("flagged"), F.col("page_count"))).withColumn("classify_ms", F.round(F.col("price") / 1000, 3))


# --- evidence and classification


@query("normalize_pages", f"""{DOCS}, raw AS (SELECT l_orderkey AS doc_id, list(l_linenumber) FILTER (l_returnflag = 'R') AS raw FROM lineitem GROUP BY ALL)
SELECT doc_id, page_count, {_j('flagged')} AS pages, coalesce(len(raw), 0)::BIGINT + 2 AS listed FROM docs LEFT JOIN raw USING (doc_id)""")
def normalize_pages(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    raw = F.concat(F.array(F.lit(0)), "raw_pages", F.array(F.col("page_count") + 1))
    return d.select("doc_id", "page_count", _s(C.normalize_pages(raw, F.col("page_count"))).alias("pages"), F.size(raw).cast("long").alias("listed"))


@query("normalize_reasons", f"""{DOCS}, r AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS page, CASE WHEN l_quantity > 25 THEN 'scan_like' ELSE 'few_text_ops' END AS reason FROM lineitem WHERE l_returnflag = 'R' AND l_discount < 0.05)
SELECT doc_id, coalesce(string_agg(page || ':' || reason, ',' ORDER BY page, reason), '') AS reasons FROM docs LEFT JOIN (SELECT DISTINCT * FROM r) USING (doc_id) GROUP BY doc_id""")
def normalize_reasons(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    bad = F.struct(F.lit(0).alias("page"), F.array(F.lit("no such page")).alias("reasons"))
    raw = F.concat(F.array(bad), F.transform("reasons", lambda r: F.struct((r["page"] + 1).alias("page"), r["reasons"].alias("reasons"))))
    out = C.normalize_reasons(raw, F.col("page_count"))
    return d.select("doc_id", F.array_join(F.transform(out, lambda r: F.concat(r["page"].cast("string"), F.lit(":"), F.array_join(r["reasons"], "+"))), ",").alias("reasons"))


@query("label_from_pages", f"{DOCS} SELECT doc_id, page_count, len(flagged)::BIGINT AS flagged_pages, {LABEL} AS label FROM docs")
def label_from_pages(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    return d.select("doc_id", "page_count", F.size("flagged").cast("long").alias("flagged_pages"), C.label(F.col("reported"), F.col("flagged"), F.col("page_count")).alias("label"))


@query("loose_type", """WITH s AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Text-Based' WHEN 1 THEN ' SCANNED ' WHEN 2 THEN 'image_based' WHEN 3 THEN 'Mixed!' WHEN 4 THEN 'text' WHEN 5 THEN '' ELSE p_type END AS spelling FROM part),
n AS (SELECT *, lower(regexp_replace(spelling, '[^A-Za-z0-9]', '', 'g')) AS plain FROM s)
SELECT p_partkey, spelling, CASE plain WHEN 'textbased' THEN 'text_based' WHEN 'scanned' THEN 'scanned' WHEN 'imagebased' THEN 'image_based' WHEN 'mixed' THEN 'mixed' ELSE 'unknown' END AS pdf_type FROM n""")
def loose_type(spark, sf_dir):
    k = F.col("p_partkey") % 7
    spelling = F.when(k == 0, "Text-Based").when(k == 1, " SCANNED ").when(k == 2, "image_based").when(k == 3, "Mixed!").when(k == 4, "text").when(k == 5, "").otherwise(F.col("p_type"))
    return A.table(spark, sf_dir, "part").select("p_partkey", spelling.alias("spelling")).withColumn("pdf_type", C.loose_type(F.col("spelling")))


@query("complement_pages", f"{DOCS} SELECT doc_id, {_j('list_filter(range(0, page_count), lambda p: NOT list_contains(flagged, p::INTEGER))')} AS text_pages, page_count > 0 AND len(flagged) >= page_count AS everywhere FROM docs")
def complement_pages(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    return d.select("doc_id", _s(C.complement(F.col("flagged"), F.col("page_count"))).alias("text_pages"), C.everywhere(F.col("flagged"), F.col("page_count")).alias("everywhere"))


@query("magic_test", """SELECT 'page' AS kind, page_id AS id, starts_with(html, '<!DOCTYPE') AS is_match, octet_length(encode(html))::BIGINT AS n_bytes FROM pages
UNION ALL SELECT 'document', doc_id, starts_with(text, '<!DOCTYPE'), octet_length(encode(text))::BIGINT FROM documents""")
def magic_test(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").cast("binary").alias("content"))
    d = A.table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    return p.unionByName(d).select("kind", "id", C.is_pdf(F.col("content"), b"<!DOCTYPE").alias("is_match"), F.octet_length("content").cast("long").alias("n_bytes"))


@query("evidence_spine", """WITH n AS (SELECT conv_id AS doc_id, max(turn)::INTEGER + 2 AS page_count FROM conversations GROUP BY conv_id),
s AS (SELECT doc_id, t.page::INTEGER AS page FROM n, unnest(range(0, page_count)) AS t(page))
SELECT doc_id, page, length(text)::BIGINT AS chars, text IS NULL AS missing FROM s LEFT JOIN conversations c ON c.conv_id = s.doc_id AND c.turn = s.page""")
def evidence_spine(spark, sf_dir):
    texts = A.conversation_pages(spark, sf_dir)
    docs = texts.groupBy("doc_id").agg((F.max("page") + 2).alias("page_count"))
    rows = evidence.with_text(evidence.spine(docs), texts)
    return rows.select("doc_id", "page", F.length("text").cast("long").alias("chars"), F.col("text").isNull().alias("missing"))


@query("page_evidence", f"""{PAGES}, {A.LINE_REASONS}
SELECT p.doc_id, p.page, coalesce(w.reason, '') AS reason, p.flagged, d.odd AS has_encoding_issues FROM pgs p JOIN docs d USING (doc_id) LEFT JOIN why w ON w.doc_id = p.doc_id AND w.page = p.page""")
def page_evidence(spark, sf_dir):
    e = A.line_evidence(spark, sf_dir)
    return e.select("doc_id", "page", F.coalesce(F.array_min("reasons"), F.lit("")).alias("reason"), F.col("flagged_by_inspector").alias("flagged"), "has_encoding_issues")


@query("verdict_contract", """WITH n AS (SELECT o_orderkey AS doc_id, coalesce(max(l_linenumber), 0) AS page_count, count(l_linenumber) AS n, count(DISTINCT l_linenumber) AS kinds FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT doc_id, CASE WHEN n <> page_count THEN 'wrong_count' WHEN kinds <> n THEN 'duplicate' ELSE 'ok' END AS status FROM n""")
def verdict_contract(spark, sf_dir):
    found = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).alias("page"))
    return evidence.contract(A.line_docs(spark, sf_dir), found)


@query("inspector_rule", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_extendedprice * 20 >= 500000 AND l_linenumber * 4 < 10) OR l_tax = 0.08 OR (l_extendedprice * 20 >= 500000 AND l_quantity < 10) OR (l_quantity < 3 AND l_extendedprice > 0) OR l_discount = 0.1 AS flagged FROM lineitem""")
def inspector_rule(spark, sf_dir):
    flag = C.inspector_flag(F.col("l_quantity"), F.col("l_extendedprice") * 20, F.col("l_linenumber") * 4, F.col("l_tax") == 0.08, F.col("l_discount") == 0.1)
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", flag.alias("flagged"))


@query("document_confidence", f"""{DOCS}, c AS (SELECT *, {LABEL} AS label FROM docs)
SELECT doc_id, label, (CASE label WHEN 'scanned' THEN 0.95 WHEN 'image_based' THEN 0.8 WHEN 'mixed' THEN 0.7 ELSE (page_count - len(flagged))::DOUBLE / page_count END)::FLOAT AS confidence, label IN ('scanned', 'image_based') AS skips_analysis FROM c""")
def document_confidence(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    lab = C.label(F.col("reported"), F.col("flagged"), F.col("page_count"))
    share = C.ratio(F.col("page_count") - F.size("flagged"), F.col("page_count"))
    return d.select("doc_id", lab.alias("label"), C.document_confidence(lab, share).alias("confidence"), evidence.skips_analysis(F.col("reported"), F.col("flagged"), F.col("page_count")).alias("skips_analysis"))


@query("classify", f"""{DOCS} SELECT doc_id, source, page_count, {_j('flagged')} AS pages_needing_ocr, {LABEL} AS pdf_type, (CASE WHEN doc_id % 101 = 0 THEN 0 ELSE confidence END)::FLOAT AS confidence FROM docs""")
def classify(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    odd = F.when(F.col("doc_id") % 202 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 101 == 0, F.lit(float("inf"))).otherwise(F.col("confidence"))
    verdicts = judges.Heuristic().judge(A.line_evidence(spark, sf_dir))
    out = evidence.classify(d.withColumn("confidence", odd), verdicts)
    return out.select("doc_id", "source", "page_count", _s("pages_needing_ocr").alias("pages_needing_ocr"), "pdf_type", "confidence")


@query("classification_defaults", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'text_based' ELSE 'unknown' END AS pdf_type, CASE WHEN p_partkey % 3 = 0 THEN 1.5 ELSE 0.0 END::DOUBLE AS classify_ms, p_partkey % 5 = 0 AS is_complex_layout, false AS has_encoding_issues, 0 AS reasons FROM part""")
def classification_defaults(spark, sf_dir):
    k = F.col("p_partkey")
    given = A.table(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, "TextBased").otherwise("x").alias("pdf_type"), F.when(k % 3 == 0, 1.5).alias("classify_ms"), F.when(k % 5 == 0, True).alias("is_complex_layout"))
    return evidence.with_defaults(given).select("p_partkey", "pdf_type", "classify_ms", "is_complex_layout", "has_encoding_issues", F.size("ocr_reasons").alias("reasons"))


# --- judges


@query("heuristic_verdicts", f"""{PAGES}, {A.LINE_REASONS}
SELECT p.doc_id, p.page, p.flagged AS needs_ocr, 1.0::FLOAT AS confidence, CASE WHEN p.flagged THEN coalesce(w.reason, 'inspector_flagged') ELSE 'inspector_clear' END AS reason FROM pgs p LEFT JOIN why w ON w.doc_id = p.doc_id AND w.page = p.page""")
def heuristic_verdicts(spark, sf_dir):
    return judges.Heuristic().judge(A.line_evidence(spark, sf_dir))


@query("prob_verdicts", f"""WITH {A.PROBABILITIES}, c AS (SELECT doc_id, page, least(greatest(probability::FLOAT, 0::FLOAT), 1::FLOAT) AS p FROM ans WHERE probability IS NOT NULL)
SELECT doc_id, page, p >= 0.5::FLOAT AS needs_ocr, (CASE WHEN p >= 0.5::FLOAT THEN p ELSE 1::FLOAT - p END)::FLOAT AS confidence FROM c""")
def prob_verdicts(spark, sf_dir):
    needs, sure = judges.verdict_columns(F.col("probability"))
    return A.probabilities(spark, sf_dir).where("probability IS NOT NULL").select("doc_id", "page", needs.alias("needs_ocr"), sure.alias("confidence"))


AMBIGUOUS = f"""amb AS (SELECT p.doc_id, bool_or(d.odd) OR (count(*) FILTER (p.flagged) > 0 AND count(*) FILTER (p.flagged) < count(*)) OR bool_or(p.flagged AND w.reason IS NULL) AS is_ambiguous
  FROM pgs p JOIN docs d USING (doc_id) LEFT JOIN why w ON w.doc_id = p.doc_id AND w.page = p.page GROUP BY p.doc_id)"""


@query("ambiguity_gate", f"{PAGES}, {A.LINE_REASONS}, {AMBIGUOUS} SELECT * FROM amb")
def ambiguity_gate(spark, sf_dir):
    return judges.ambiguous(A.line_evidence(spark, sf_dir))


def _settled_sql(gated: bool, strict: bool) -> str:
    clear = "NOT is_ambiguous" if gated else "false"
    why = "CASE lost " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAILURES.items()) + " END"
    return f"""{PAGES}, {A.LINE_REASONS}, {AMBIGUOUS}, {A.PROBABILITIES},
f AS (SELECT doc_id, arg_min(failure, page) AS failed FROM ans WHERE failure IS NOT NULL GROUP BY doc_id),
j AS (SELECT p.doc_id, p.page, p.flagged, w.reason AS own, least(greatest(a.probability::FLOAT, 0::FLOAT), 1::FLOAT) AS prob, coalesce(f.failed, CASE WHEN a.probability IS NULL THEN 'protocol' END) AS lost, {clear} AS clear
  FROM pgs p JOIN amb USING (doc_id) LEFT JOIN why w ON w.doc_id = p.doc_id AND w.page = p.page LEFT JOIN ans a ON a.doc_id = p.doc_id AND a.page = p.page LEFT JOIN f ON f.doc_id = p.doc_id)
SELECT doc_id, page, CASE WHEN NOT clear AND lost IS NULL THEN prob >= 0.5::FLOAT ELSE flagged END AS needs_ocr,
  (CASE WHEN NOT clear AND lost IS NULL THEN CASE WHEN prob >= 0.5::FLOAT THEN prob ELSE 1::FLOAT - prob END ELSE 1.0 END)::FLOAT AS confidence,
  CASE WHEN clear THEN '{GATED_REASON}' WHEN lost IS NOT NULL THEN {why} WHEN prob >= 0.5::FLOAT THEN '{ASKED_NEEDS}' ELSE '{ASKED_CLEAR}' END AS reason FROM j""" + (" WHERE clear OR lost IS NULL" if strict else "")


@query("fallback_relabel", _settled_sql(False, False))
def fallback_relabel(spark, sf_dir):
    return judges.settled(A.line_evidence(spark, sf_dir), A.probabilities(spark, sf_dir))


def _replayed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Evidence and a hosted judge's answers, written as those of a real run are: lineitem is read once for each."""
    return kept(A.line_evidence(spark, sf_dir), "evidence"), kept(A.probabilities(spark, sf_dir), "answers")


@query("gated_relabel", _settled_sql(True, False))
def gated_relabel(spark, sf_dir):
    return judges.settled(*_replayed(spark, sf_dir), gated=True)


@query("strict_verdicts", _settled_sql(False, True))
def strict_verdicts(spark, sf_dir):
    return judges.settled(*_replayed(spark, sf_dir), strict=True)


@query("fallback_counts", f"SELECT reason, count(*)::BIGINT AS pages FROM ({_settled_sql(True, False)}) v WHERE reason IN {FAILED_REASONS} GROUP BY reason")
def fallback_counts(spark, sf_dir):
    return judges.fallback_counts(gated_relabel(spark, sf_dir))


@query("fallback_note", f"SELECT 'judge `{HOSTED}` fell back to the heuristic: ' || string_agg(pages || ' page(s) ' || reason, ', ' ORDER BY reason) AS note FROM (SELECT reason, count(*) AS pages FROM ({_settled_sql(True, False)}) v WHERE reason IN {FAILED_REASONS} GROUP BY reason) c HAVING count(*) > 0")
def fallback_note(spark, sf_dir):
    parts = fallback_counts(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("reason", "pages"))).alias("p")).where("size(p) > 0")
    text = F.array_join(F.transform("p", lambda x: F.concat(x["pages"].cast("string"), F.lit(" page(s) "), x["reason"])), ", ")
    return parts.select(F.concat(F.lit(f"judge `{HOSTED}` fell back to the heuristic: "), text).alias("note"))


@query("answer_match", """WITH a AS (SELECT event_id, event_id % 5 AS k, value FROM events)
SELECT event_id AS doc_id, 0 AS page, CASE WHEN k NOT IN (1, 2, 3) THEN least(greatest(CASE WHEN k = 4 THEN value / 100 - 1 ELSE value / 1000 END, 0.0), 1.0) END AS probability, CASE WHEN k IN (1, 2, 3) THEN 'protocol' END AS failure FROM a""")
def answer_match(spark, sf_dir):
    k, v = F.col("event_id") % 5, F.col("value")
    entry = lambda key, kind, x: F.create_map(F.lit(key), F.struct(F.lit(kind).alias("type"), x.cast("double").alias("noul")))
    answers = F.when(k == 1, entry("page_7", "noul", v)).when(k == 2, entry("page_0", "text", v)).when(k == 3, F.when(v > 20, entry("page_0", "noul", F.lit(None))).otherwise(entry("page_0", "noul", F.lit(float("nan"))))).when(k == 4, entry("page_0", "noul", v / 100 - 1)).otherwise(entry("page_0", "noul", v / 1000))
    return judges.matched(A.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("page"), answers.alias("answers")))


@query("page_state_clip", """SELECT conv_id AS doc_id, turn::INTEGER AS page, 'page_' || turn AS question, substr(text || text || text || text, 1, 2000) AS text, length(text || text || text || text)::INTEGER AS text_chars, length(text || text || text || text) > 2000 AS text_truncated FROM conversations""")
def page_state_clip(spark, sf_dir):
    pages = A.conversation_pages(spark, sf_dir).withColumn("text", F.concat("text", "text", "text", "text"))
    return judges.page_state(pages).select("doc_id", "page", "question", "text", "text_chars", "text_truncated")


def _chunk_sql(most_pages: int, most_bytes: int) -> str:
    return f"""WITH RECURSIVE s AS (SELECT conv_id AS doc_id, turn AS page, octet_length(encode(text))::BIGINT AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
c AS (SELECT doc_id, page, i, 0 AS chunk, 1 AS held, size AS bytes FROM s WHERE i = 1
  UNION ALL SELECT s.doc_id, s.page, s.i, c.chunk + (c.held >= {most_pages} OR c.bytes + s.size > {most_bytes})::INTEGER, CASE WHEN c.held >= {most_pages} OR c.bytes + s.size > {most_bytes} THEN 1 ELSE c.held + 1 END, CASE WHEN c.held >= {most_pages} OR c.bytes + s.size > {most_bytes} THEN s.size ELSE c.bytes + s.size END
  FROM c JOIN s ON s.doc_id = c.doc_id AND s.i = c.i + 1)
SELECT doc_id, page::INTEGER AS page, chunk::INTEGER AS chunk FROM c"""


@query("greedy_chunks", _chunk_sql(3, 1200))
def greedy_chunks(spark, sf_dir):
    return judges.chunk_ids(A.conversation_pages(spark, sf_dir).select("doc_id", "page", F.octet_length(F.col("text").cast("binary")).alias("size")), most_pages=3, most_bytes=1200)


@query("request_chunks", """WITH s AS (SELECT conv_id AS doc_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations)
SELECT doc_id, chunk::INTEGER AS chunk, 'judge-model' AS model, string_agg('page_' || turn, ',' ORDER BY turn) AS questions,
  md5(string_agg(concat_ws('|', turn::VARCHAR, substr(text, 1, 2000), length(text)::VARCHAR, CASE WHEN length(text) > 2000 THEN 'true' ELSE 'false' END), ';' ORDER BY turn)) AS digest, 'noul' AS kinds FROM s GROUP BY doc_id, chunk""")
def request_chunks(spark, sf_dir):
    pages = judges.page_state(A.conversation_pages(spark, sf_dir))
    states = pages.select("doc_id", "page", "question", judges.state_json(pages).alias("state"))
    chunks = judges.chunk_ids(states.select("doc_id", "page", judges.wire_size(F.col("page"), F.col("state")).alias("size")), most_pages=3)
    bodies = judges.request_bodies(states.join(chunks, ["doc_id", "page"]), "judge-model")
    seen = F.from_json("body", "model STRING, state ARRAY<STRUCT<page INT, text STRING, text_chars INT, text_truncated BOOLEAN>>, questions MAP<STRING, STRUCT<type STRING, instructions STRING>>")
    b = bodies.select("doc_id", "chunk", seen.alias("b"))
    asked = F.array_join(F.map_keys("b.questions"), ",")
    texts = F.md5(F.array_join(F.transform("b.state", lambda x: F.concat_ws("|", x["page"].cast("string"), x["text"], x["text_chars"].cast("string"), x["text_truncated"].cast("string"))), ";").cast("binary"))
    kinds = F.array_join(F.array_distinct(F.transform(F.map_values("b.questions"), lambda q: q["type"])), ",")
    return b.select("doc_id", "chunk", "b.model", asked.alias("questions"), texts.alias("digest"), kinds.alias("kinds"))


@query("breaker_state", f"""WITH RECURSIVE {A.EVENT_LOG.strip()},
o AS (SELECT judge, ts_ms, ok, row_number() OVER (PARTITION BY judge ORDER BY ts_ms) AS i FROM log),
b AS (SELECT judge, ts_ms, ok, i, false AS refused, CASE WHEN ok THEN 0 ELSE 1 END AS run, NULL::BIGINT AS opened FROM o WHERE i = 1
  UNION ALL SELECT o.judge, o.ts_ms, o.ok, o.i, n.open,
    CASE WHEN n.open THEN b.run WHEN o.ok THEN 0 WHEN n.cooled THEN 1 ELSE b.run + 1 END,
    CASE WHEN n.open THEN b.opened WHEN o.ok THEN NULL WHEN (CASE WHEN n.cooled THEN 1 ELSE b.run + 1 END) >= 2 THEN o.ts_ms END
  FROM b JOIN o ON o.judge = b.judge AND o.i = b.i + 1, LATERAL (SELECT b.opened IS NOT NULL AND o.ts_ms - b.opened >= 3600000 AS cooled, b.opened IS NOT NULL AND o.ts_ms - b.opened < 3600000 AS open) n)
SELECT judge, ts_ms, ok, refused, run::INTEGER AS run FROM b""")
def breaker_state(spark, sf_dir):
    return judges.breaker_log(A.event_log(spark, sf_dir), limit=2, cool_off_ms=3_600_000)


# --- policy


def _plan_sql(cfg: Config, docs: str = "docs") -> str:
    unsure, n = f"confidence < {cfg.min_confidence}::FLOAT", "page_count"
    text = "list_filter(range(0, page_count), lambda p: NOT list_contains(flagged, p::INTEGER))"
    premium = f"'{cfg.tiers.premium}'" if cfg.tiers.premium else "NULL"
    return f"""r AS (SELECT *, CASE WHEN {unsure} THEN 'low_confidence' WHEN len(flagged) = 0 THEN 'text_layer' WHEN len(flagged) >= {n} THEN 'scanned' ELSE '{'mixed_split' if cfg.split_pages else 'mixed_unsplit'}' END AS reason FROM {docs}),
t AS (SELECT *, CASE WHEN reason = 'low_confidence' THEN 'standard' WHEN reason = 'text_layer' THEN 'local' WHEN is_complex THEN '{cfg.complex_tier()}' ELSE 'standard' END AS tier FROM r),
m AS (SELECT *, CASE tier WHEN 'local' THEN '{cfg.tiers.local}' WHEN 'standard' THEN '{cfg.tiers.standard}' ELSE {premium} END AS routed_model FROM t),
plans AS (SELECT *, CASE WHEN reason = 'mixed_split' THEN 2 ELSE 1 END AS n_legs, CASE WHEN reason = 'mixed_split' THEN '{cfg.tiers.local}/local/' || {_j(text)} || ';' || routed_model || '/' || tier || '/' || {_j('flagged')} ELSE routed_model || '/' || tier || '/all' END AS legs FROM m)"""


def _legs_text(legs: Column) -> Column:
    return F.array_join(F.transform(legs, lambda x: F.concat_ws("/", x["model"], x["tier"], F.coalesce(F.array_join(x["pages"].cast("array<string>"), ","), F.lit("all")))), ";")


def _plan_query(name: str, cfg: Config) -> None:
    @query(f"plan_route_{name}", f"{DOCS}, {_plan_sql(cfg)} SELECT doc_id, reason, tier, routed_model, legs, n_legs > 1 AS is_split FROM plans")
    def plan_route(spark, sf_dir):
        return policy.plan(_classified(spark, sf_dir), cfg).select("doc_id", "reason", "tier", "routed_model", _legs_text(F.col("legs")).alias("legs"), "is_split")


for _name, _cfg in VARIANTS.items():
    _plan_query(_name, _cfg)

GOLDEN = " UNION ALL ".join(f"(WITH {_plan_sql(c)} SELECT '{v}' AS variant, reason, tier, count(*)::BIGINT AS documents FROM plans GROUP BY reason, tier)" for v, c in VARIANTS.items())


@query("plan_variants", f"{DOCS} {GOLDEN}")
def plan_variants(spark, sf_dir):
    docs, out = _classified(spark, sf_dir), None
    for name, cfg in VARIANTS.items():
        one = policy.plan(docs, cfg).groupBy("reason", "tier").agg(F.count(F.lit(1)).alias("documents")).select(F.lit(name).alias("variant"), "reason", "tier", "documents")
        out = one if out is None else out.unionByName(one)
    return out


@query("ocr_tier", f"{DOCS} SELECT doc_id, CASE WHEN is_complex THEN 'premium' ELSE 'standard' END AS with_premium, 'standard' AS without_premium FROM docs")
def ocr_tier(spark, sf_dir):
    d = A.line_docs(spark, sf_dir)
    return d.select("doc_id", policy.ocr_tier(F.col("is_complex_layout"), VARIANTS["premium"]).alias("with_premium"), policy.ocr_tier(F.col("is_complex_layout"), VARIANTS["no_premium"]).alias("without_premium"))


BYPASS_CFG = Config(Models(premium="premium-ocr"), max_document_bytes=200_000)


def _decide_input(spark, sf_dir) -> DataFrame:
    d = _classified(spark, sf_dir)
    k = F.col("doc_id")
    return d.withColumn("is_image", k % 11 == 0).withColumn("is_pdf", k % 7 != 0).withColumn("n_bytes", F.floor("price")).withColumn("failed", k % 13 == 0)


DECIDE = f"""{DOCS}, {_plan_sql(BYPASS_CFG)},
g AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'image' WHEN doc_id % 7 = 0 THEN 'not_pdf' WHEN floor(price) > 200000 THEN 'oversize' WHEN doc_id % 13 = 0 THEN 'classifier_unavailable' END AS gate, CASE WHEN doc_id % 2 = 0 THEN ' own-model' ELSE '  ' END AS wanted FROM plans),
dec AS (SELECT doc_id, CASE WHEN gate IS NULL THEN 'route' ELSE 'bypass' END AS kind, coalesce(gate, reason) AS why, CASE WHEN gate IS NULL THEN tier ELSE 'bypass' END AS tier, CASE WHEN gate IS NULL THEN routed_model WHEN trim(wanted) <> '' THEN wanted ELSE 'mistral-ocr' END AS routed_model, CASE WHEN gate IS NULL THEN legs END AS legs, page_count, flagged, confidence, {LABEL} AS pdf_type, CASE WHEN gate IS NULL THEN n_legs > 1 END AS split FROM g)"""


def _decided(spark, sf_dir) -> DataFrame:
    return policy.decide(_decide_input(spark, sf_dir), BYPASS_CFG, F.when(F.col("doc_id") % 2 == 0, " own-model").otherwise("  "))


@query("decide_bypass", f"{DECIDE} SELECT doc_id, kind, why AS reason, tier, routed_model, legs FROM dec")
def decide_bypass(spark, sf_dir):
    return _decided(spark, sf_dir).select("doc_id", "kind", "reason", "tier", "routed_model", _legs_text(F.col("legs")).alias("legs"))


@query("metadata_flat", f"""{DECIDE} SELECT doc_id, kind, tier, why AS reason, CASE WHEN kind = 'route' THEN pdf_type END AS pdf_type, CASE WHEN kind = 'route' THEN confidence END AS confidence, CASE WHEN kind = 'route' THEN page_count END AS page_count,
CASE WHEN kind = 'route' THEN {_j('flagged')} END AS pages_needing_ocr, routed_model, split FROM dec""")
def metadata_flat(spark, sf_dir):
    m = policy.metadata(_decided(spark, sf_dir))
    return m.select("doc_id", "kind", "metadata.tier", "metadata.reason", "metadata.pdf_type", "metadata.confidence", "metadata.page_count", _s("metadata.pages_needing_ocr").alias("pages_needing_ocr"), "metadata.routed_model", "metadata.split")


@query("metadata_json", f"""{DECIDE} SELECT doc_id, tier, why AS reason, CASE WHEN kind = 'route' THEN pdf_type END AS pdf_type, CASE WHEN kind = 'route' THEN confidence::VARCHAR::DOUBLE END AS confidence, CASE WHEN kind = 'route' THEN page_count END AS page_count,
CASE WHEN kind = 'route' THEN {_j('flagged')} END AS pages_needing_ocr, routed_model, legs, split,
CASE WHEN kind = 'route' THEN 'tier,reason,pdf_type,confidence,page_count,pages_needing_ocr,classify_ms,routed_model,legs,split' ELSE 'tier,reason,routed_model' END AS keys FROM dec""")
def metadata_json(spark, sf_dir):
    told = policy.metadata(_decided(spark, sf_dir)).select("doc_id", policy.metadata_json(F.col("metadata")).alias("json"))
    leg = "ARRAY<STRUCT<model STRING, tier STRING, pages ARRAY<INT>>>"
    m = F.from_json("json", f"tier STRING, reason STRING, pdf_type STRING, confidence DOUBLE, page_count INT, pages_needing_ocr ARRAY<INT>, routed_model STRING, legs {leg}, split BOOLEAN").alias("m")
    m = told.select("doc_id", m, F.array_join(F.json_object_keys("json"), ",").alias("keys"))
    return m.select("doc_id", "m.tier", "m.reason", "m.pdf_type", "m.confidence", "m.page_count", _s("m.pages_needing_ocr").alias("pages_needing_ocr"), "m.routed_model", _legs_text(F.col("m.legs")).alias("legs"), "m.split", "keys")


# --- execution


EXEC = VARIANTS["no_premium"]
LEGS = f"""{DOCS}, {_plan_sql(EXEC)}, lg AS (SELECT doc_id, i::INTEGER AS leg_no, page_count, CASE WHEN n_legs = 2 AND i = 0 THEN '{EXEC.tiers.local}' ELSE routed_model END AS model, CASE WHEN n_legs = 2 AND i = 0 THEN 'local' ELSE tier END AS tier,
  CASE WHEN n_legs = 2 AND i = 0 THEN list_filter(range(0, page_count), lambda p: NOT list_contains(flagged, p::INTEGER)) WHEN n_legs = 2 THEN flagged::BIGINT[] END AS pages FROM plans, unnest(range(0, n_legs)) AS u(i))"""


def _planned(spark, sf_dir) -> DataFrame:
    return policy.plan(_classified(spark, sf_dir), EXEC).withColumn("kind", F.lit("route"))


@query("legs_exploded", f"{LEGS} SELECT doc_id, leg_no, model, tier, coalesce({_j('pages')}, 'all') AS pages, tier = 'local' AS is_local FROM lg")
def legs_exploded(spark, sf_dir):
    rows = execution.legs(_planned(spark, sf_dir))
    return rows.select("doc_id", "leg_no", "model", "tier", F.coalesce(_s("pages"), F.lit("all")).alias("pages"), "is_local")


def _results(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Plans and the results of their legs, where a host is played by expressions: page i of document d reads d:i; every 9th document's OCR leg fails."""
    planned = _planned(spark, sf_dir)
    return planned, _done(planned)


def _done(planned: DataFrame) -> DataFrame:
    rows = execution.legs(planned, "page_count")
    all_ = F.coalesce("pages", C.all_pages(F.col("page_count")))
    fails = ~F.col("is_local") & (F.col("doc_id") % 9 == 0)
    pages = F.transform(F.reverse(all_), lambda p: F.struct(p.alias("index"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), p.cast("string")).alias("markdown")))
    none = F.array().cast("array<struct<index:int,markdown:string>>")
    done = rows.select("doc_id", "leg_no", "model", F.when(fails, none).otherwise(pages).alias("pages"), F.when(fails, 0).otherwise(F.size(all_)).alias("pages_processed"), F.when(~F.col("is_local") & ~fails, (F.col("doc_id") % 1000)).alias("doc_size_bytes"), F.when(fails, F.concat(F.col("model"), F.lit(" is down"))).alias("error"))
    return done


def _retried(spark, sf_dir, planned: DataFrame, done: DataFrame) -> DataFrame:
    """The retry: fails again for every 27th document."""
    again = execution.needs_retry(planned, done, EXEC, "retry-model", "page_count")
    fails = F.col("doc_id") % 27 == 0
    pages = F.transform(C.all_pages(F.col("page_count")), lambda p: F.struct(p.alias("index"), F.concat(F.lit("again "), p.cast("string")).alias("markdown")))
    none = F.array().cast("array<struct<index:int,markdown:string>>")
    return again.select("doc_id", "leg_no", "model", F.when(fails, none).otherwise(pages).alias("pages"), F.when(fails, 0).otherwise(F.col("page_count")).alias("pages_processed"), F.lit(None).cast("long").alias("doc_size_bytes"), F.when(fails, "retry is down").alias("error"))


DONE = f"""{LEGS}, done AS (SELECT doc_id, leg_no, model, tier, page_count, CASE WHEN tier <> 'local' AND doc_id % 9 = 0 THEN []::BIGINT[] ELSE coalesce(pages, range(0, page_count)) END AS pages, CASE WHEN tier <> 'local' AND doc_id % 9 = 0 THEN model || ' is down' END AS error, CASE WHEN tier <> 'local' AND doc_id % 9 <> 0 THEN doc_id % 1000 END AS size FROM lg)"""


@query("first_failure", f"{DONE} SELECT doc_id, min(leg_no)::INTEGER AS leg_no, arg_min(error, leg_no) AS error FROM done WHERE error IS NOT NULL GROUP BY doc_id")
def first_failure(spark, sf_dir):
    _, done = _results(spark, sf_dir)
    return judges.first_failures(done.where("error IS NOT NULL").select("doc_id", "leg_no", "error"))


@query("leg_fallback", f"""{DONE}, bad AS (SELECT doc_id, arg_min(error, leg_no) AS first_error FROM done WHERE error IS NOT NULL GROUP BY doc_id)
SELECT p.doc_id, CASE WHEN b.doc_id IS NOT NULL AND p.doc_id % 27 <> 0 THEN 'leg_failed' END AS fallback_reason, CASE WHEN b.doc_id IS NOT NULL AND p.doc_id % 27 <> 0 THEN 'retry-model' ELSE routed_model END AS routed_model,
  CASE WHEN b.doc_id IS NOT NULL AND p.doc_id % 27 = 0 THEN 'retry is down (after ' || first_error || ')' END AS error FROM plans p LEFT JOIN bad b ON b.doc_id = p.doc_id""")
def leg_fallback(spark, sf_dir):
    # As in a real run, plans and results of calls are written before they are used again.
    planned = kept(_planned(spark, sf_dir).select("doc_id", "kind", "routed_model", "tier", "legs", "page_count"), "plans")
    done = kept(_done(planned), "results")
    return execution.with_fallback(planned, done, _retried(spark, sf_dir, planned, done))[1]


@query("remap_pages", f"{DOCS} SELECT doc_id, t.i::INTEGER AS index, coalesce(flagged[t.i + 1], t.i)::INTEGER AS page FROM docs, unnest(range(0, len(flagged) + 2)) AS t(i)")
def remap_pages(spark, sf_dir):
    d = A.line_docs(spark, sf_dir).withColumn("index", F.explode(F.sequence(F.lit(0), F.size("flagged") + 1)))
    return d.select("doc_id", "index", execution.remap(F.col("index"), F.col("flagged")).alias("page"))


@query("merge_pages", f"""{DONE}, pg AS (SELECT doc_id, leg_no, model, t.p AS index, doc_id || ':' || t.p AS markdown FROM done, unnest(pages) AS t(p))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY index, leg_no) - 1)::INTEGER AS at, index::INTEGER AS index, markdown, model FROM pg""")
def merge_pages(spark, sf_dir):
    return execution.merged_pages(_results(spark, sf_dir)[1])


@query("merge_summary", f"{DONE} SELECT doc_id, string_agg(model, ',' ORDER BY leg_no) AS model, sum(len(pages))::BIGINT AS pages_processed, max(size)::BIGINT AS doc_size_bytes FROM done GROUP BY doc_id")
def merge_summary(spark, sf_dir):
    return execution.merged_summary(_results(spark, sf_dir)[1])


@query("local_extract", """WITH c AS (SELECT conv_id AS doc_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)
SELECT doc_id, len(list_filter(turns, lambda t: t % 2 = 0))::BIGINT AS pages, array_to_string(list_filter(turns, lambda t: t % 2 = 0), ',') AS numbers FROM c""")
def local_extract(spark, sf_dir):
    texts = A.conversation_pages(spark, sf_dir).select("doc_id", "page", "text")
    rows = texts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("page") % 2 == 0, F.col("page")))).alias("pages"))
    rows = rows.select("doc_id", F.lit(0).alias("leg_no"), F.lit(EXEC.tiers.local).alias("model"), F.lit("local").alias("tier"), "pages", F.lit(True).alias("is_local"))
    return execution.local(rows, texts).select("doc_id", F.col("pages_processed").cast("long").alias("pages"), _s(F.transform("pages", lambda p: p["index"])).alias("numbers"))


@query("leg_timing", f"""{LEGS}, cl AS (SELECT doc_id, model, leg_no, doc_id % 97 + k * 100 AS elapsed_ms, k AS call_no, coalesce({_j('pages')}, 'all') AS pages FROM lg, unnest([1, 2]) AS u(k) WHERE tier <> 'local')
SELECT doc_id, leg_no, model, (SELECT arg_min(elapsed_ms, call_no) FROM cl WHERE cl.doc_id = lg.doc_id AND cl.model = lg.model AND cl.pages = coalesce({_j('lg.pages')}, 'all'))::BIGINT AS elapsed_ms FROM lg""")
def leg_timing(spark, sf_dir):
    rows = execution.legs(_planned(spark, sf_dir))
    calls = rows.where("NOT is_local").withColumn("call_no", F.explode(F.array(F.lit(1), F.lit(2))))
    log = calls.select("doc_id", "model", "pages", "call_no", (F.col("doc_id") % 97 + F.col("call_no") * 100).alias("elapsed_ms"))
    return execution.leg_timing(rows, log).select("doc_id", "leg_no", "model", "elapsed_ms")


@query("page_preview", r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\r$', '')), lambda x: NOT regexp_matches(x, '^\s*$')) AS lines FROM documents)
SELECT doc_id, CASE WHEN len(lines) = 0 THEN '(empty)' WHEN length(lines[1]) > 80 THEN substr(lines[1], 1, 80) || '…' ELSE lines[1] END AS preview FROM l""")
def page_preview(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"))


@query("error_clip", "SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '…' ELSE text END AS message FROM documents")
def error_clip(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", C.clip(F.col("text"), 300).alias("message"))


@query("error_class", """WITH k AS (SELECT event_id, list_value('config', 'not_pdf', 'parse', 'page_range', 'host', 'leg_failed')[event_id % 6 + 1] AS kind, list_value('config', 'parse', 'host')[event_id % 3 + 1] AS inside FROM events),
e AS (SELECT *, CASE WHEN kind = 'leg_failed' THEN inside ELSE kind END AS k2 FROM k) SELECT event_id, kind, CASE WHEN k2 = 'config' THEN 'config' WHEN k2 IN ('not_pdf', 'parse', 'page_range') THEN 'pdf' ELSE 'host' END AS class FROM e""")
def error_class(spark, sf_dir):
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), (F.col("event_id") % n).cast("int"))
    e = A.table(spark, sf_dir, "events").select("event_id", pick(6, "config", "not_pdf", "parse", "page_range", "host", "leg_failed").alias("kind"), pick(3, "config", "parse", "host").alias("inside"))
    return e.select("event_id", "kind", execution.error_class(F.col("kind"), F.col("inside")).alias("class"))


@query("request_body", """SELECT page_id, 'mistral-ocr' AS model, 'document_url' AS kind, md5(html) AS digest, CASE WHEN page_id % 2 = 0 THEN '0,2' END AS pages, CASE WHEN page_id % 2 = 0 THEN 'model,document,pages' ELSE 'model,document' END AS keys FROM pages""")
def request_body(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages").select("page_id", F.lit("mistral-ocr").alias("model"), F.col("html").cast("binary").alias("content"), F.when(F.col("page_id") % 2 == 0, F.array(F.lit(0), F.lit(2))).alias("pages"))
    seen = F.from_json("body", "model STRING, document STRUCT<type STRING, document_url STRING>, pages ARRAY<INT>")
    b = p.select("page_id", execution.request_body(p).alias("body")).select("page_id", seen.alias("b"), F.array_join(F.json_object_keys("body"), ",").alias("keys"))
    content = F.unbase64(F.regexp_extract("b.document.document_url", "^data:application/pdf;base64,(.*)$", 1))
    return b.select("page_id", "b.model", F.col("b.document.type").alias("kind"), F.md5(content).alias("digest"), _s("b.pages").alias("pages"), "keys")


@query("ocr_response", """WITH c AS (SELECT conv_id, count(*) AS n, conv_id % 3 AS k FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN k = 0 THEN 'asked' ELSE 'served' END AS model, n::INTEGER AS pages, CASE WHEN k = 1 THEN (n + 5)::INTEGER ELSE n::INTEGER END AS pages_processed, CASE WHEN k = 1 THEN 1234::BIGINT END AS doc_size_bytes, array_to_string(range(0, n), ',') AS numbers FROM c""")
def ocr_response(spark, sf_dir):
    k = F.col("conv_id") % 3
    grouped = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    pages = F.to_json(F.transform("t", lambda x: F.struct(F.when(k == 2, x["turn"]).alias("index"), F.when(x["turn"] > 0, x["text"]).alias("markdown"))))
    usage = F.when(k == 1, F.concat(F.lit(',"usage_info":{"pages_processed":'), (F.size("t") + 5).cast("string"), F.lit(',"doc_size_bytes":1234}'))).otherwise("")
    text = F.concat(F.lit('{"model":"'), F.when(k == 0, "  ").otherwise("served"), F.lit('","pages":'), pages, usage, F.lit("}"))
    r = grouped.select("conv_id", execution.response(text, F.lit("asked")).alias("r"))
    return r.select("conv_id", "r.model", F.size("r.pages").alias("pages"), "r.pages_processed", "r.doc_size_bytes", _s(F.transform("r.pages", lambda p: p["index"])).alias("numbers"))


@query("leg_defaults", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'local_pdf/extract' ELSE p_brand END AS model, CASE WHEN p_partkey % 3 = 0 THEN 'premium' WHEN p_partkey % 2 = 0 THEN 'local' ELSE 'standard' END AS tier FROM part""")
def leg_defaults(spark, sf_dir):
    model = F.when(F.col("p_partkey") % 2 == 0, EXEC.tiers.local).otherwise(F.col("p_brand"))
    return A.table(spark, sf_dir, "part").select("p_partkey", model.alias("model"), execution.leg_tier(F.when(F.col("p_partkey") % 3 == 0, "premium"), model, EXEC).alias("tier"))


# --- scoring


COUNTS = "count(*) FILTER (flagged AND truly)::BIGINT AS correct_ocr, count(*) FILTER (NOT flagged AND NOT truly)::BIGINT AS correct_local, count(*) FILTER (NOT flagged AND truly)::BIGINT AS missed_ocr, count(*) FILTER (flagged AND NOT truly)::BIGINT AS wasted_ocr"
SCORES = f"""{PAGES}, sc AS (SELECT d.doc_id, d.source, d.page_count, {COUNTS.replace('flagged', 'p.flagged').replace('truly', 'p.truly')} FROM docs d LEFT JOIN pgs p ON p.doc_id = d.doc_id GROUP BY d.doc_id, d.source, d.page_count),
g AS (SELECT source, count(*)::BIGINT AS documents, count(*) FILTER (missed_ocr = 0 AND wasted_ocr = 0)::BIGINT AS exact, sum(correct_ocr)::BIGINT AS correct_ocr, sum(correct_local)::BIGINT AS correct_local, sum(missed_ocr)::BIGINT AS missed_ocr, sum(wasted_ocr)::BIGINT AS wasted_ocr FROM sc GROUP BY source)"""


def _scored(spark, sf_dir) -> DataFrame:
    return scoring.score_lists(A.line_docs(spark, sf_dir))


def _groups(spark, sf_dir) -> DataFrame:
    return scoring.add(_scored(spark, sf_dir), "source")


@query("confusion_by_doc", f"""{PAGES} SELECT doc_id, {COUNTS}, coalesce(string_agg(page, ',' ORDER BY page) FILTER (NOT flagged AND truly), '') AS missed_pages, coalesce(string_agg(page, ',' ORDER BY page) FILTER (flagged AND NOT truly), '') AS wasted_pages,
bool_and(flagged = truly) AS route_exact FROM pgs GROUP BY doc_id""")
def confusion_by_doc(spark, sf_dir):
    s = _scored(spark, sf_dir).where("page_count > 0")
    return s.select("doc_id", *scoring.COUNTS, _s("missed_pages").alias("missed_pages"), _s("wasted_pages").alias("wasted_pages"), "route_exact")


@query("judge_confusion", f"""{PAGES}, {A.PROBABILITIES}, v AS (SELECT a.doc_id, a.page, least(greatest(a.probability::FLOAT, 0::FLOAT), 1::FLOAT) >= 0.5::FLOAT AS flagged, list_contains(d.truth, a.page) AS truly FROM ans a JOIN docs d ON d.doc_id = a.doc_id WHERE a.probability IS NOT NULL)
SELECT doc_id, {COUNTS}, coalesce(string_agg(page, ',' ORDER BY page) FILTER (NOT flagged AND truly), '') AS missed_pages, coalesce(string_agg(page, ',' ORDER BY page) FILTER (flagged AND NOT truly), '') AS wasted_pages, bool_and(flagged = truly) AS route_exact FROM v GROUP BY doc_id""")
def judge_confusion(spark, sf_dir):
    s = scoring.score_pages(prob_verdicts(spark, sf_dir), A.line_truth(spark, sf_dir))
    return s.select("doc_id", *scoring.COUNTS, _s("missed_pages").alias("missed_pages"), _s("wasted_pages").alias("wasted_pages"), "route_exact")


@query("confusion_by_source", f"{SCORES} SELECT * FROM g UNION ALL SELECT '(all)', sum(documents)::BIGINT, sum(exact)::BIGINT, sum(correct_ocr)::BIGINT, sum(correct_local)::BIGINT, sum(missed_ocr)::BIGINT, sum(wasted_ocr)::BIGINT FROM g")
def confusion_by_source(spark, sf_dir):
    return bench.by_source(_scored(spark, sf_dir)).withColumn("source", F.coalesce("source", F.lit("(all)")))


TOTALS = "correct_ocr + correct_local + missed_ocr + wasted_ocr"


@query("totals_by_source", f"{SCORES} SELECT source, {TOTALS} AS pages, correct_ocr + missed_ocr AS truly_needs_ocr, correct_local + wasted_ocr AS truly_local, missed_ocr = 0 AND wasted_ocr = 0 AS is_perfect FROM g")
def totals_by_source(spark, sf_dir):
    return scoring.with_totals(_groups(spark, sf_dir)).select("source", "pages", "truly_needs_ocr", "truly_local", "is_perfect")


RATES = "correct_ocr::DOUBLE / nullif(correct_ocr + wasted_ocr, 0) AS precision, correct_ocr::DOUBLE / nullif(correct_ocr + missed_ocr, 0) AS recall"


def _rates_sql(of: str, key: str) -> str:
    return f"r AS (SELECT {key}, {RATES} FROM {of}) SELECT {key}, precision, recall, CASE WHEN precision IS NULL OR recall IS NULL THEN NULL WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r"


@query("rates", f"{SCORES}, {_rates_sql('sc', 'doc_id')}")
def rates(spark, sf_dir):
    return scoring.with_rates(_scored(spark, sf_dir)).select("doc_id", "precision", "recall", "f1")


@query("rates_by_source", f"{SCORES}, {_rates_sql('g', 'source')}")
def rates_by_source(spark, sf_dir):
    return scoring.with_rates(_groups(spark, sf_dir)).select("source", "precision", "recall", "f1")


@query("rates_block", f"{SCORES} SELECT source, CASE WHEN correct_ocr + wasted_ocr = 0 THEN 'n/a (nothing was routed)' ELSE printf('%.3f', correct_ocr::DOUBLE / (correct_ocr + wasted_ocr)) END AS precision, CASE WHEN correct_ocr + missed_ocr = 0 THEN 'n/a (nothing needed it)' ELSE printf('%.3f', correct_ocr::DOUBLE / (correct_ocr + missed_ocr)) END AS recall FROM g")
def rates_block(spark, sf_dir):
    r = scoring.with_rates(_groups(spark, sf_dir))
    return r.select("source", C.rate_text(F.col("precision"), "nothing was routed").alias("precision"), C.rate_text(F.col("recall"), "nothing needed it").alias("recall"))


COST = f"""cost AS (SELECT source, correct_ocr + wasted_ocr AS ocr_pages_n, correct_ocr + missed_ocr AS ideal_ocr_pages, {TOTALS} AS all_pages, wasted_ocr AS overspend_pages, missed_ocr AS underspend_pages FROM g),
cv AS (SELECT *, overspend_pages::DOUBLE * {PRICE} AS overspend, underspend_pages::DOUBLE * {PRICE} AS underspend, all_pages::DOUBLE * {PRICE} AS naive, ocr_pages_n::DOUBLE * {PRICE} AS routed, ideal_ocr_pages::DOUBLE * {PRICE} AS ideal, ocr_pages_n::DOUBLE / nullif(all_pages, 0) AS routed_share FROM cost),
cc AS (SELECT *, naive - routed AS saving, naive - ideal AS ceiling_saving, ideal_ocr_pages - ocr_pages_n AS saving_beyond_ceiling_pages FROM cv)"""
COST_COLUMNS = ["source", "ocr_pages_n", "ideal_ocr_pages", "all_pages", "overspend_pages", "underspend_pages", "overspend", "underspend", "naive", "routed", "ideal", "routed_share", "saving", "ceiling_saving", "saving_beyond_ceiling_pages"]


@query("cost_view", f"{SCORES}, {COST} SELECT * FROM cc")
def cost_view(spark, sf_dir):
    return scoring.with_cost(_groups(spark, sf_dir), PRICE).select(*COST_COLUMNS)


@query("ceiling_verdict", f"{SCORES}, {COST} SELECT source, CASE WHEN saving_beyond_ceiling_pages > 0 THEN 'beyond' WHEN saving_beyond_ceiling_pages < 0 THEN 'short' WHEN underspend_pages = 0 AND overspend_pages = 0 THEN 'exact' ELSE 'cancelled' END AS verdict FROM cc")
def ceiling_verdict(spark, sf_dir):
    return scoring.with_cost(_groups(spark, sf_dir), PRICE).select("source", scoring.ceiling_verdict().alias("verdict"))


@query("savings_block", f"{SCORES}, {COST} SELECT source, all_pages - ocr_pages_n AS saved_pages, all_pages - ideal_ocr_pages AS ceiling_pages, saving, ceiling_saving, all_pages > 0 AS scored FROM cc")
def savings_block(spark, sf_dir):
    c = scoring.with_cost(_groups(spark, sf_dir), PRICE)
    return c.select("source", (F.col("all_pages") - F.col("ocr_pages_n")).alias("saved_pages"), (F.col("all_pages") - F.col("ideal_ocr_pages")).alias("ceiling_pages"), "saving", "ceiling_saving", (F.col("all_pages") > 0).alias("scored"))


USAGE = f"WITH {A.EVENT_LOG.strip()}, u AS (SELECT judge, count(*)::BIGINT AS calls, count(input_tokens)::BIGINT AS reporting, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, 0::BIGINT AS output_tokens FROM log GROUP BY judge)"


@query("token_meter", f"{USAGE} SELECT * FROM u")
def token_meter(spark, sf_dir):
    return scoring.token_usage(A.event_log(spark, sf_dir), "judge")


SPEND = f"sp AS (SELECT *, calls = reporting AS complete, CASE WHEN calls = reporting AND input_tokens = 0 THEN 0.0::DOUBLE ELSE input_tokens::DOUBLE / 1000000.0::DOUBLE * {PER_MILLION}::DOUBLE END AS judge_cost FROM u)"


@query("judge_spend", f"{USAGE}, {SPEND} SELECT * FROM sp")
def judge_spend(spark, sf_dir):
    return scoring.with_spend(token_meter(spark, sf_dir), PER_MILLION)


@query("judge_net", f"""{USAGE}, {SPEND} SELECT judge, CASE WHEN calls = 0 THEN 'no_calls' WHEN reporting = 0 THEN 'unreported' WHEN judge_cost IS NULL THEN 'unpriced' WHEN complete THEN 'priced' ELSE 'floor' END AS state, calls::DOUBLE * {PRICE} - judge_cost AS net FROM sp""")
def judge_net(spark, sf_dir):
    s = judge_spend(spark, sf_dir)
    return s.select("judge", scoring.judge_state().alias("state"), (F.col("calls").cast("double") * PRICE - F.col("judge_cost")).alias("net"))


@query("latency_summary", f"WITH {A.EVENT_LOG.strip()} SELECT kind, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, max(ms) AS max, count(ms)::BIGINT AS documents FROM log GROUP BY kind")
def latency_summary(spark, sf_dir):
    return scoring.latency(A.event_log(spark, sf_dir), "kind")


@query("median_repeat", f"WITH {A.EVENT_LOG.strip()} SELECT judge, kind, median(ms) AS ms, arg_max(ok, call_no) AS verdict FROM log GROUP BY judge, kind")
def median_repeat(spark, sf_dir):
    log = A.event_log(spark, sf_dir).select("judge", "kind", F.col("call_no").alias("run_no"), "ms", F.col("ok").alias("verdict"))
    return bench.repeats(log, "judge", "kind")


TIMES = """WITH base AS (SELECT event_type AS judge, user_id AS doc_id, median(value) AS ms FROM events GROUP BY ALL), first AS (SELECT min(event_type) AS b FROM events),
d AS (SELECT t.judge, t.doc_id, t.ms, CASE WHEN t.judge <> (SELECT b FROM first) THEN t.ms - z.ms END AS delta_ms FROM base t LEFT JOIN base z ON z.doc_id = t.doc_id AND z.judge = (SELECT b FROM first))"""


def _deltas(spark, sf_dir) -> DataFrame:
    times = A.event_log(spark, sf_dir).groupBy(F.col("kind").alias("judge"), F.col("judge").alias("doc_id")).agg(F.median("ms").alias("ms"))
    first = A.event_log(spark, sf_dir).agg(F.min("kind")).first()[0]
    return bench.with_delta(times, first)


@query("baseline_delta", f"{TIMES} SELECT * FROM d")
def baseline_delta(spark, sf_dir):
    return _deltas(spark, sf_dir)


@query("overhead", f"{TIMES} SELECT judge, median(delta_ms) AS overhead_ms FROM d GROUP BY judge")
def overhead(spark, sf_dir):
    return bench.overhead(_deltas(spark, sf_dir))


JUDGED = f"""{PAGES}, {A.PROBABILITIES}, jd AS (SELECT a.doc_id, a.page, (CASE WHEN p.pr >= 0.5::FLOAT THEN p.pr ELSE 1::FLOAT - p.pr END)::FLOAT AS confidence, (p.pr >= 0.5::FLOAT) = list_contains(d.truth, a.page) AS right_
  FROM ans a JOIN docs d ON d.doc_id = a.doc_id, LATERAL (SELECT least(greatest(a.probability::FLOAT, 0::FLOAT), 1::FLOAT) AS pr) p WHERE a.probability IS NOT NULL)"""


def _judged(spark, sf_dir) -> DataFrame:
    docs = A.line_docs(spark, sf_dir).select("doc_id", "truth")
    return prob_verdicts(spark, sf_dir).join(docs, "doc_id").select("doc_id", "page", "confidence", (F.col("needs_ocr") == F.array_contains("truth", F.col("page"))).alias("right"))


@query("confidence_distinct", f"{JUDGED} SELECT confidence, count(*)::BIGINT AS verdicts FROM jd GROUP BY confidence")
def confidence_distinct(spark, sf_dir):
    return scoring.confidences(_judged(spark, sf_dir))


@query("reliability", f"{JUDGED} SELECT least(greatest(floor(confidence::DOUBLE * 10), 0), 9)::INTEGER AS bucket, count(*)::BIGINT AS verdicts, count(*) FILTER (right_)::BIGINT AS correct, avg(confidence::DOUBLE) AS mean_confidence, count(*) FILTER (right_)::DOUBLE / count(*) AS accuracy FROM jd GROUP BY 1")
def reliability(spark, sf_dir):
    return scoring.reliability(_judged(spark, sf_dir))


@query("brier", f"{JUDGED} SELECT count(*)::BIGINT AS verdicts, count(DISTINCT confidence)::BIGINT AS distinct_confidences, false AS degenerate, NULL::FLOAT AS constant, round(avg((confidence::DOUBLE - right_::INTEGER::DOUBLE) * (confidence::DOUBLE - right_::INTEGER::DOUBLE)), 10) AS brier FROM jd")
def brier(spark, sf_dir):
    # Rounded, as the order of summing moves the last digits.
    return scoring.brier(_judged(spark, sf_dir)).withColumn("brier", F.round("brier", 10))


@query("brier_degenerate", f"""{PAGES}, v AS (SELECT (CASE WHEN page >= 0 THEN 1.0 END)::FLOAT AS c, flagged AS r FROM pgs)
SELECT count(*)::BIGINT AS verdicts, count(DISTINCT c)::BIGINT AS distinct_confidences, count(DISTINCT c) < 2 AS degenerate, CASE WHEN count(DISTINCT c) = 1 THEN min(c) END AS constant, CASE WHEN count(DISTINCT c) > 1 THEN avg((c - r::INTEGER) ** 2) END AS brier FROM v""")
def brier_degenerate(spark, sf_dir):
    verdicts = judges.Heuristic().judge(A.line_evidence(spark, sf_dir))
    return scoring.brier(verdicts.select("confidence", F.col("needs_ocr").alias("right")))


# --- bench and report


@query("judge_by_document", f"{DOCS} SELECT doc_id, j.judge FROM docs, (VALUES ('heuristic'), ('{HOSTED}')) AS j(judge)")
def judge_by_document(spark, sf_dir):
    names = spark.createDataFrame([("heuristic",), (HOSTED,)], "judge string")
    return bench.every_judge(A.line_docs(spark, sf_dir).select("doc_id"), names)


FAILED = "bad AS (SELECT DISTINCT doc_id FROM ans WHERE failure IS NOT NULL)"


@query("doc_exclusion", f"{PAGES}, {A.PROBABILITIES}, {FAILED} SELECT source, count(*)::BIGINT AS documents FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM bad) GROUP BY source")
def doc_exclusion(spark, sf_dir):
    failures = A.probabilities(spark, sf_dir).where("failure IS NOT NULL")
    return bench.exclude(A.line_docs(spark, sf_dir), failures).groupBy("source").agg(F.count(F.lit(1)).alias("documents"))


@query("page_count_mismatch", f"{DOCS}, k AS (SELECT l_orderkey AS doc_id, count(DISTINCT l_linenumber)::INTEGER AS found FROM lineitem GROUP BY ALL) SELECT doc_id, page_count AS expected, found FROM docs JOIN k USING (doc_id) WHERE page_count <> found")
def page_count_mismatch(spark, sf_dir):
    found = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.countDistinct("l_linenumber").cast("int").alias("page_count"))
    return bench.count_mismatch(A.line_docs(spark, sf_dir), found)


@query("verdict_consistency", f"""{DOCS}, v AS (SELECT l_orderkey AS doc_id, count(*)::BIGINT AS verdicts, coalesce(string_agg(l_linenumber - 1, ',' ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), '') AS routed FROM lineitem GROUP BY ALL)
SELECT doc_id, coalesce(verdicts, 0)::BIGINT AS verdicts, page_count, coalesce(routed, '') AS routed FROM docs LEFT JOIN v USING (doc_id) WHERE coalesce(verdicts, 0) <> page_count OR coalesce(routed, '') <> {_j('flagged')}""")
def verdict_consistency(spark, sf_dir):
    verdicts = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") - 1).cast("int").alias("page"), (F.col("l_returnflag") == "R").alias("needs_ocr"))
    return bench.inconsistent(_classified(spark, sf_dir), verdicts).select("doc_id", "verdicts", "page_count", _s("routed").alias("routed"))


@query("truth_validation", f"""WITH t AS (SELECT o_orderkey AS doc_id, coalesce(max(l_linenumber), 0)::INTEGER - 1 AS page_count, coalesce(list((l_linenumber - 1)::INTEGER) FILTER (l_linestatus = 'F'), []::INTEGER[]) AS pages FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)
SELECT doc_id, CASE WHEN len(list_distinct(pages)) < len(pages) THEN 'duplicate page' WHEN len(list_filter(pages, lambda p: p >= page_count)) > 0 THEN 'page out of range' END AS error, {_j('list_sort(pages)')} AS pages FROM t""")
def truth_validation(spark, sf_dir):
    from ..sources.corpus import truth_error

    lines = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg((F.max("l_linenumber") - 1).cast("int").alias("n"), F.collect_list(F.when(F.col("l_linestatus") == "F", (F.col("l_linenumber") - 1).cast("int"))).alias("needs_ocr"))
    d = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).join(lines, "doc_id", "left").withColumn("page_count", F.coalesce("n", F.lit(-1))).withColumn("needs_ocr", F.coalesce("needs_ocr", C.no_pages()))
    return d.select("doc_id", truth_error(F.col("needs_ocr"), F.col("page_count")).alias("error"), _s(F.array_sort("needs_ocr")).alias("pages"))


@query("sources_first_seen", "SELECT source, row_number() OVER (ORDER BY min(doc_id))::INTEGER AS at FROM documents GROUP BY source")
def sources_first_seen(spark, sf_dir):
    return bench.first_seen(A.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq")))


@query("synthetic_caveat", f"""{PAGES}, s AS (SELECT d.doc_id % 20000 AS grp, count(p.page) AS pages, count(*) FILTER (p.flagged <> p.truly) AS wrong, count(DISTINCT d.doc_id) AS documents FROM docs d LEFT JOIN pgs p ON p.doc_id = d.doc_id GROUP BY 1)
SELECT 'heuristic' AS judge, 'Synthetic' AS source, grp, documents::BIGINT AS documents, pages::BIGINT AS pages FROM s WHERE wrong = 0 AND pages > 0 AND grp % 2 = 0""")
def synthetic_caveat(spark, sf_dir):
    s = _scored(spark, sf_dir).withColumn("grp", F.col("doc_id") % 20000)
    g = scoring.add(s, "grp").withColumn("judge", F.lit("heuristic")).withColumn("source", F.when(F.col("grp") % 2 == 0, "Synthetic").otherwise("adversarial"))
    totals = scoring.with_totals(g)
    return totals.join(bench.synthetic_caveats(g).select("source").distinct(), "source", "left_semi").where("is_perfect AND pages > 0").select("judge", "source", "grp", "documents", "pages")


@query("run_ok", f"{PAGES}, {A.PROBABILITIES}, {FAILED} SELECT (count(*) = 0) AS ok, count(*)::BIGINT AS failures FROM bad")
def run_ok(spark, sf_dir):
    bad = A.probabilities(spark, sf_dir).where("failure IS NOT NULL").select("doc_id").distinct()
    return bad.agg((F.count(F.lit(1)) == 0).alias("ok"), F.count(F.lit(1)).alias("failures"))


@query("group_line", f"{SCORES} SELECT source, source || ': ' || documents || ' document(s), ' || ({TOTALS}) || ' page(s), ' || missed_ocr || ' missed, ' || wasted_ocr || ' wasted, ' || exact || '/' || documents || ' exact' AS line FROM g")
def group_line(spark, sf_dir):
    return _groups(spark, sf_dir).select("source", bench.group_line().alias("line"))


@query("documents_block", f"""{SCORES}, pl AS (SELECT doc_id, coalesce('[' || string_agg(page, ',' ORDER BY page) FILTER (truly AND NOT flagged) || ']', 'none') AS missed, coalesce('[' || string_agg(page, ',' ORDER BY page) FILTER (flagged AND NOT truly) || ']', 'none') AS wasted FROM pgs GROUP BY doc_id)
SELECT sc.doc_id, page_count AS pages, missed_ocr, wasted_ocr, CASE WHEN missed_ocr = 0 AND wasted_ocr = 0 THEN 'exact' ELSE 'OFF' END AS route, coalesce(missed, 'none') AS missed_pages, coalesce(wasted, 'none') AS wasted_pages FROM sc LEFT JOIN pl ON pl.doc_id = sc.doc_id""")
def documents_block(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("doc_id", F.col("page_count").alias("pages"), "missed_ocr", "wasted_ocr", F.when(F.col("route_exact"), "exact").otherwise("OFF").alias("route"), C.format_pages(F.col("missed_pages")).alias("missed_pages"), C.format_pages(F.col("wasted_pages")).alias("wasted_pages"))


@query("sources_block", f"{SCORES} SELECT source, documents, {TOTALS} AS pages, missed_ocr, wasted_ocr, exact || '/' || documents AS exact FROM g")
def sources_block(spark, sf_dir):
    g = _groups(spark, sf_dir)
    return g.select("source", "documents", scoring.pages().alias("pages"), "missed_ocr", "wasted_ocr", F.concat_ws("/", F.col("exact").cast("string"), F.col("documents").cast("string")).alias("exact"))


@query("judge_names", "SELECT string_agg(CASE WHEN n = 'heuristic' THEN n || ' (baseline)' ELSE n END, ', ' ORDER BY i) AS names FROM (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(JUDGES)) + ") AS v(i, n)")
def judge_names(spark, sf_dir):
    names = spark.createDataFrame(list(enumerate(JUDGES)), "i int, n string")
    shown = F.when(F.col("n") == bench.BASELINE, F.concat("n", F.lit(" (baseline)"))).otherwise(F.col("n"))
    return names.agg(F.array_sort(F.collect_list(F.struct("i", shown.alias("s")))).alias("p")).select(F.array_join(F.transform("p", lambda x: x["s"]), ", ").alias("names"))


@query("classification_line", f"""{DOCS} SELECT doc_id, {LABEL} || ' (confidence ' || printf('%.2f', confidence) || '), ' || page_count || ' page(s), ' || len(flagged) || ' needing OCR ' || CASE WHEN len(flagged) = 0 THEN 'none' ELSE '[' || {_j('flagged')} || ']' END || ', ' || CASE WHEN is_complex THEN 'complex layout' ELSE 'simple layout' END AS line FROM docs""")
def classification_line(spark, sf_dir):
    d = _classified(spark, sf_dir)
    line = F.format_string("%s (confidence %.2f), %d page(s), %d needing OCR %s, %s", F.col("pdf_type"), F.col("confidence").cast("double"), F.col("page_count"), F.size("flagged"), C.format_pages(F.col("flagged")), F.when(F.col("is_complex_layout"), "complex layout").otherwise("simple layout"))
    return d.select("doc_id", line.alias("line"))


@query("document_label", "SELECT page_id, coalesce(nullif(trim(string_split(url, '/')[-1]), ''), url) AS label, CASE WHEN starts_with(url, '/') THEN url ELSE '/corpus/' || url END AS path FROM pages")
def document_label(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", C.base_name(F.col("url")).alias("label"), C.resolve(F.lit("/corpus"), F.col("url")).alias("path"))


@query("mojibake", "SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', '" + "".join(chr(ord(c) + 0x400) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") + "')) AS digest FROM documents")
def mojibake(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(C.mojibake(F.col("text")).cast("binary")).alias("digest"))


@query("recipe_pages", """SELECT conv_id, count(*)::INTEGER AS page_count, coalesce(string_agg(turn, ',' ORDER BY turn) FILTER (role = 'user'), '') AS needs_ocr FROM conversations GROUP BY conv_id""")
def recipe_pages(spark, sf_dir):
    from ..fixtures import build

    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") == "user", "s").otherwise("t").alias("k")))), lambda x: x["k"]), "")
    recipes = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(kinds.alias("kinds")).withColumnRenamed("conv_id", "document").withColumn("source", F.lit("synthetic"))
    pages = build(recipes)
    return pages.groupBy(F.col("document").alias("conv_id")).agg(F.count(F.lit(1)).cast("int").alias("page_count"), _s(F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page"))))).alias("needs_ocr"))


@query("write_state", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'wrote' WHEN doc_id % 3 = 1 THEN 'unchanged' WHEN length(text) % 2 = 0 THEN 'wrote' ELSE 'kept' END AS state FROM documents""")
def write_state(spark, sf_dir):
    from ..fixtures import write_state as state

    new = F.col("text").cast("binary")
    old = F.when(F.col("doc_id") % 3 == 1, new).when(F.col("doc_id") % 3 == 2, F.concat(new, F.lit(b"x")))
    return A.table(spark, sf_dir, "documents").select("doc_id", state(new, old, F.length("text") % 2 == 0).alias("state"))


@query("call_windows", """SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type AS kind, count(*)::BIGINT AS calls, count(*) FILTER (event_type = 'error')::BIGINT AS failures, max(value) AS slowest FROM events GROUP BY ALL""")
def call_windows(spark, sf_dir):
    from ..streaming.calls import windowed

    e = A.table(spark, sf_dir, "events").select(F.col("ts"), F.col("event_type").alias("kind"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("ms"))
    return windowed(e)


