"""Edge cases of single operators."""

import math

import pytest
from pyspark.sql import functions as F

from leafwise import config as conf
from leafwise import fixtures
from leafwise.functions import columns as C
from leafwise.operators import bench, execution, judges, policy, scoring
from leafwise.sources import corpus


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_page_lists(spark):
    n = F.lit(4)
    raw = F.array(*map(F.lit, [3, 0, 5, 1, 3]))
    row = one(spark, C.normalize_pages(raw, n).alias("a"), C.complement(F.array(F.lit(1)), F.lit(3)).alias("b"), C.complement(C.no_pages(), F.lit(0)).alias("c"), C.format_pages(F.lit(None).cast("array<int>")).alias("d"), C.format_pages(C.no_pages()).alias("e"))
    assert (row.a, row.b, row.c, row.d, row.e) == ([0, 2], [0, 2], [], "all", "none")


def test_float_buckets(spark):
    row = one(spark, *[C.bucket(F.lit(x).cast("float")).alias(f"x{i}") for i, x in enumerate((0.0, 0.7, 0.9, 1.0))])
    assert list(row) == [0, 6, 8, 9]


def test_confidence_at_threshold_is_enough(spark):
    df = spark.range(1).select(F.lit(0.7).cast("float").alias("confidence"), F.lit(False).alias("is_complex_layout"), F.array(F.lit(0)).alias("pages_needing_ocr"), F.lit(2).alias("page_count"))
    assert policy.plan(df, conf.Config(min_confidence=0.7)).first().reason == "mixed_split"


def test_rates_undefined(spark):
    df = spark.createDataFrame([(0, 2, 0, 0), (0, 0, 3, 0), (0, 0, 0, 2), (0, 0, 0, 0)], "correct_ocr long, correct_local long, missed_ocr long, wasted_ocr long")
    got = [(r.precision, r.recall, r.f1) for r in scoring.with_rates(df).collect()]
    assert got == [(None, None, None), (None, 0.0, None), (0.0, None, None), (None, None, None)]


def test_brier_and_degenerate(spark):
    rows = [(0.95, True), (0.95, True), (0.55, True), (0.55, False)]
    df = spark.createDataFrame(rows, "confidence double, right boolean").withColumn("confidence", F.col("confidence").cast("float"))
    assert scoring.brier(df).first().brier == pytest.approx((2 * 0.05**2 + 0.45**2 + 0.55**2) / 4, abs=1e-6)
    assert scoring.reliability(df).count() == 2
    assert scoring.reliability(df.where("confidence > 0.9")).count() == 0


def test_spend_states(spark):
    df = spark.createDataFrame([("a", 2, 2, 0), ("b", 2, 1, 0), ("c", 2, 2, 10**6)], "judge string, calls long, reporting long, input_tokens long")
    got = {r.judge: r.judge_cost for r in scoring.with_spend(df, None).collect()}
    assert got == {"a": 0.0, "b": None, "c": None}
    assert {r.judge: r.judge_cost for r in scoring.with_spend(df, 0.5).collect()} == {"a": 0.0, "b": 0.0, "c": 0.5}


def test_chunk_bounds(spark):
    sizes = spark.range(103).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page"), F.lit(10).alias("size"))
    counts = [r["count"] for r in judges.chunk_ids(sizes).groupBy("chunk").count().orderBy("chunk").collect()]
    assert counts == [50, 50, 3]
    big = sizes.where("page < 3").withColumn("size", F.lit(judges.MAX_BYTES))
    assert judges.chunk_ids(big).select("chunk").distinct().count() == 3


def test_breaker_matches_a_plain_loop(spark):
    import random

    draw, rows = random.Random(3), []
    for judge in range(4):
        t = 0
        for _ in range(200):
            t += draw.randint(1, 40)
            rows.append((judge, t, draw.random() < 0.4))
    expected = {}
    for limit in (3,):
        for judge in range(4):
            count, opened = 0, None
            for j, t, ok in rows:
                if j == judge:
                    if opened is not None and t - opened >= 50:
                        count, opened = 0, None
                    expected[judge, t] = opened is not None
                    if opened is None:
                        count = 0 if ok else count + 1
                        opened = t if not ok and count >= limit else None
    got = judges.breaker_log(spark.createDataFrame(rows, "judge long, ts_ms long, ok boolean"), limit=3, cool_off_ms=50)
    assert {(r.judge, r.ts_ms): r.refused for r in got.collect()} == expected
    assert not any(r.refused for r in judges.breaker_log(spark.createDataFrame(rows, "judge long, ts_ms long, ok boolean"), limit=0, cool_off_ms=50).collect())


def test_breaker_stream_matches_batch(spark, tmp_path):
    from leafwise.streaming.calls import breaker, windowed

    rows = [(k % 3, 10 * k, k % 5 > 2) for k in range(60)]
    df = spark.createDataFrame(rows, "judge long, ts_ms long, ok boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = breaker(stream, limit=2, cool_off_ms=100).writeStream.format("memory").queryName("breaker").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.judge, r.ts_ms, r.refused, r.run)
    assert sorted(map(key, spark.table("breaker").collect())) == sorted(map(key, judges.breaker_log(df, limit=2, cool_off_ms=100).collect()))
    calls = spark.createDataFrame([(k, "a", True, 1.0) for k in range(3)], "s long, kind string, ok boolean, ms double").withColumn("ts", F.timestamp_seconds("s"))
    assert windowed(calls).first().calls == 3


def test_answers(spark):
    rows = [(1, {"page_0": ("noul", 0.7)}), (2, {}), (3, {"page_0": ("text", 0.7)}), (4, {"page_0": ("noul", math.inf)}), (5, {"page_0": ("noul", 1.7)}), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, answers map<string,struct<type:string,noul:double>>").withColumn("page", F.lit(0))
    got = {r.doc_id: (r.probability, r.failure) for r in judges.matched(df).collect()}
    assert got == {1: (0.7, None), 2: (None, "protocol"), 3: (None, "protocol"), 4: (None, "protocol"), 5: (1.0, None), 6: (None, "protocol")}


def test_metadata_json(spark):
    legs = "array<struct<model:string,tier:string,pages:array<int>>>"
    m = spark.createDataFrame([("route", 'a"b', [("m", "local", [0]), ("n", "standard", None)]), ("bypass", "image", None)], f"kind string, reason string, legs {legs}")
    m = m.select("*", F.lit("t").alias("tier"), F.lit("mixed").alias("pdf_type"), F.lit(0.7).cast("float").alias("confidence"), F.lit(2).alias("page_count"), F.array(F.lit(1)).alias("pages_needing_ocr"), F.lit(1.5).alias("classify_ms"), F.lit("n").alias("routed_model"), F.lit(True).alias("is_split"))
    got = {r.kind: r.j for r in policy.metadata(m).select("kind", policy.metadata_json(F.col("metadata")).alias("j")).collect()}
    assert got["route"] == '{"tier":"t","reason":"a\\"b","pdf_type":"mixed","confidence":0.7,"page_count":2,"pages_needing_ocr":[1],"classify_ms":1.5,"routed_model":"n","legs":[{"model":"m","tier":"local","pages":[0]},{"model":"n","tier":"standard","pages":null}],"split":true}'
    assert got["bypass"].startswith('{"tier":"t","reason":"image","routed_model":"n"')


def test_merge_keeps_duplicates_and_order(spark):
    page = "array<struct<index:int,markdown:string>>"
    df = spark.createDataFrame([(1, 1, "b", [(1, "x"), (0, "y")], 2, 5), (1, 0, "a", [(1, "z")], 1, None)], f"doc_id long, leg_no int, model string, pages {page}, pages_processed int, doc_size_bytes long")
    assert [(r["index"], r.markdown, r.model) for r in execution.merged_pages(df).orderBy("at").collect()] == [(0, "y", "b"), (1, "z", "a"), (1, "x", "b")]
    row = execution.merged_summary(df).first()
    assert (row.model, row.pages_processed, row.doc_size_bytes) == ("a,b", 3, 5)


def test_config_errors(tmp_path):
    for bad in ('{"min_confidence": 2}', '{"nope": 1}', "[]", "{", '{"tiers": {"local": " "}}', '{"max_document_bytes": 0}', '{"tiers": {"x": "y"}}'):
        with pytest.raises(conf.ConfigError):
            conf.from_json(bad)
    with pytest.raises(conf.ConfigError, match="can't be read"):
        conf.load(str(tmp_path / "none.json"))
    assert conf.load() == conf.Config() and conf.from_json("{}").complex_tier() == "standard"


def test_manifest(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text('{"documents": [{"file": "a/b.pdf", "source": "s", "page_count": 3, "needs_ocr": [2, 0]}, {"file": "/c.pdf", "source": "t", "page_count": 1, "needs_ocr": []}]}')
    rows = corpus.load_manifest(spark, str(path)).orderBy("seq").collect()
    assert [(r.path, r.label, r.needs_ocr) for r in rows] == [(f"{tmp_path}/a/b.pdf", "b.pdf", [0, 2]), ("/c.pdf", "c.pdf", [])]
    for bad in ('{"documents": [{"file": "a", "page_count": 1, "needs_ocr": [0, 0]}]}', '{"documents": [{"file": "a", "page_count": 1, "needs_ocr": [1]}]}', '{"documents": [{"file": "a", "x": 1}]}', '{"documents": []}', '{"documents": [], "y": 1}'):
        path.write_text(bad)
        with pytest.raises(corpus.CorpusError):
            corpus.load_manifest(spark, str(path))


def test_environment_files():
    assert corpus.parse_env("# c\nexport A=1\nB='x y'\nC=a=b\nbad line\n =x\nD=") == {"A": "1", "B": "x y", "C": "a=b", "D": ""}
    assert corpus.unset_pairs({"A": "1", "B": "2"}, {"A": "0"}) == {"B": "2"}
    assert corpus.api_key(" ", {corpus.KEY_VARIABLES[1]: "k"}) == "k" and corpus.api_key("f", {}) == "f"


def test_judge_registry():
    assert bench.judge_list([conf.JUDGES[1], "heuristic"], judges.registry()) == (["heuristic"], [(conf.JUDGES[1], "no API key")])
    with pytest.raises(KeyError):
        judges.by_name("nobody")
    assert judges.threshold(math.nan) == 0.5 and judges.threshold(7) == 1.0


def test_text_damage():
    lines = fixtures.body_lines("a", 0, 5)
    assert lines == fixtures.body_lines("a", 0, 5) and len(lines) == 5 and all(len(x) <= 72 for x in lines)
    assert fixtures.garble(lines, "s") != lines and fixtures.wrap(["aa", "bb", "c" * 9], 5) == ["aa bb", "c" * 9]


def test_retries_are_joined_without_broadcast(spark, tmp_path):
    """Compressed, a table of millions of ids looks small enough to be broadcast, and then fills the driver."""

    def stored(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    def run(df):
        return sorted(map(tuple, df.collect()), key=str), df._jdf.queryExecution().executedPlan().toString()

    planned = stored(spark.createDataFrame([(1, "route", "ocr", 4), (2, "route", "ocr", 5), (3, "route", "ocr", 6), (4, "bypass", "own", 7)], "doc_id long, kind string, routed_model string, page_count int"), "planned")
    page, result = [(0, "x")], "doc_id long, leg_no int, model string, pages array<struct<index:int,markdown:string>>, pages_processed int, doc_size_bytes long, error string"
    rows = [(1, 0, "local", page, 1, None, None), (1, 1, "ocr", [], 0, None, "down"), (2, 0, "ocr", page, 1, 9, None), (3, 1, "ocr", [], 0, None, "late"), (3, 0, "ocr", [], 0, None, "first"), (4, 0, "own", [], 0, None, "gone")]
    results = stored(spark.createDataFrame(rows, result), "results")
    assert "BroadcastHashJoin" in run(results.join(planned, "doc_id"))[1]
    again = execution.needs_retry(planned, results, conf.Config(), "backup", "page_count")
    got, plan = run(again)
    assert got == [(1, 0, "backup", "standard", None, False, 4), (3, 0, "backup", "standard", None, False, 6)] and "Broadcast" not in plan
    got, plan = run(execution.needs_retry(planned, results, conf.Config(), "backup"))
    assert [r[0] for r in got] == [1, 3] and "Broadcast" not in plan
    retried = stored(spark.createDataFrame([(1, 0, "backup", page, 1, None, None), (3, 0, "backup", [], 0, None, "again")], result), "retried")
    merged, docs = execution.with_fallback(planned, results, retried)
    got, plan = run(docs)
    assert got == [(1, "leg_failed", "backup", None), (2, None, "ocr", None), (3, None, "ocr", "again (after first)"), (4, None, "own", "no retry (after gone)")] and "Broadcast" not in plan
    got, plan = run(merged.select("doc_id", "model"))
    assert got == [(1, "backup"), (2, "ocr")] and "Broadcast" not in plan
