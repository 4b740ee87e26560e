"""Archives are read back whole, by ranges, with revisits."""

import base64
import hashlib

from pyspark.sql import functions as F

from leafwise.llm import warc
from leafwise.llm.common import importable

ROWS = [(1, "http://a/é", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "u", "z" * 300_000), (6, "u", "<p>é</p>"), (None, "n", "lone"), (8, "r", "WARC/1.1\r\n\r\nbody")]


def test_round_trip(spark):
    importable(spark)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("file", F.lit("clash")).repartition(3)
    index = warc.write(pages)
    assert index.count() == len(ROWS) and index.where("length <= 0 OR offset < 0").count() == 0
    back = {r.page_id: r for r in warc.fetch(index).collect()}
    for page_id, url, html in ROWS:
        body = (html or "").encode()
        r = back[page_id]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        first = min((p for p, _, h in ROWS if (h or "") == (html or "") and p is not None), default=None)
        revisit = page_id is not None and page_id != first
        assert (r.record_type, r.refers_to) == (("revisit", first) if revisit else ("response", None))
        assert (r.payload is None) if revisit else bytes(r.payload) == body
        assert r.url == (None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"))


def test_a_selection_and_a_least_size(spark):
    importable(spark)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1)
    index = warc.write(pages, least=5)
    some = warc.fetch(index.where("page_id IN (2, 5)")).collect()
    assert sorted((r.page_id, r.record_type) for r in some) == [(2, "revisit"), (5, "response")]
    assert warc.fetch(index).where("page_id = 4 AND record_type = 'response'").count() == 1
    assert warc.fetch(warc.write(pages.limit(0))).count() == 0


def test_repeated_rows(spark):
    importable(spark)
    pages = spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.record_type) for r in warc.fetch(warc.write(pages)).collect()) == [(1, "response"), (1, "response"), (2, "revisit")]


def test_an_id_with_several_payloads_and_rows_without_id(spark):
    importable(spark)
    rows = [(1, "u", "x"), (5, "u", "x"), (5, "u", "UNIQUE"), (5, "v", "x"), (3, "u", "UNIQUE"), (None, "a", "x"), (None, "b", "x")]
    back = warc.fetch(warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))).collect()
    got = sorted((-1 if r.page_id is None else r.page_id, r.url, r.record_type, r.refers_to or 0, bytes(r.payload or b"").decode()) for r in back)
    assert got == [(-1, "a", "response", 0, "x"), (-1, "b", "response", 0, "x"), (1, "u", "response", 0, "x"), (3, "u", "response", 0, "UNIQUE"), (5, "u", "revisit", 1, ""), (5, "u", "revisit", 3, ""), (5, "v", "revisit", 1, "")]


def test_payloads_that_pack_well_come_in_batches(spark, monkeypatch):
    importable(spark)
    monkeypatch.setattr(warc, "BYTES_A_BATCH", 1 << 20)
    pages = spark.range(12).selectExpr("id AS page_id", "'u' AS url", "concat(id, repeat('z', 900000)) AS html").coalesce(1)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.fetch(warc.write(pages)).select("page_id", "payload_bytes").collect()) == [(i, 900_000 + len(str(i))) for i in range(12)]
