"""The hosted judge against a local stub server, through operators and the command line."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from leafwise import api, cli, fixtures
from leafwise import config as conf
from leafwise.operators import evidence, hosted, judges
from leafwise.sources import pdf

EVIDENCE = "doc_id long, page int, text string, reasons array<string>, flagged_by_inspector boolean, has_tables boolean, has_columns boolean, has_encoding_issues boolean"


class Stub(http.server.ThreadingHTTPServer):
    """Answers by the text of a page: 'scan' needs OCR; the words fail, odd, mute make the answer fail in a way of their own."""

    def __init__(self):
        self.seen = []
        super().__init__(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server_address[1]}"


class Handler(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, self.headers["Authorization"], body))
        texts = {s["page"]: s["text"] or "" for s in body["state"]}
        answers = {f"page_{p}": {"type": "noul", "noul": 0.9 if "scan" in t or not t else 0.2} for p, t in texts.items()}
        if any("odd" in t for t in texts.values()):
            answers = {}
        out = json.dumps({"answers": answers, "usage": {"input_tokens": 100 * len(texts), "output_tokens": 1}}).encode()
        if any("mute" in t for t in texts.values()):
            out = b"no json"
        self.send_response(503 if any("fail" in t for t in texts.values()) else 200)
        self.send_header("Content-Length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def stub():
    server = Stub()
    yield server
    server.shutdown()


def rows(texts, doc_id=1, flagged=()):
    return [(doc_id, p, t, [], p in flagged, False, False, False) for p, t in enumerate(texts)]


def verdicts(spark, judge, found):
    return sorted((r.doc_id, r.page, r.needs_ocr, round(r.confidence, 3), r.reason) for r in judge.judge(spark.createDataFrame(found, EVIDENCE).repartition(1)).collect())


def test_answers_failures_and_log(spark, stub):
    judge = hosted.Hosted(hosted.Http(stub.url + "/", "k"), limit=0)
    found = rows(["a scan", "text"], 1) + rows(["text", "fail"], 2, flagged=[1]) + rows(["odd"], 3) + rows(["mute"], 4)
    assert verdicts(spark, judge, found) == [
        (1, 0, True, 0.9, "jev_needs_ocr"), (1, 1, False, 0.8, "jev_clear"), (2, 0, False, 1.0, "jev_fallback_http"), (2, 1, True, 1.0, "jev_fallback_http"), (3, 0, False, 1.0, "jev_fallback_protocol"), (4, 0, False, 1.0, "jev_fallback_protocol")]
    log = {r.doc_id: r for r in judge.log[0].collect()}
    assert (log[1].status, log[1].input_tokens, log[1].failure) == (200, 200, None) and (log[2].status, log[2].failure) == (503, "http") and log[3].input_tokens == 100 and log[4].failure == "protocol"
    path, key, body = next(x for x in stub.seen if len(x[2]["state"]) == 2)
    assert (path, key) == (hosted.PATH, "Bearer k") and list(body) == ["model", "state", "questions"] and sorted(body["questions"]) == ["page_0", "page_1"]
    strict = hosted.Hosted(hosted.Http(stub.url, "k"), strict=True, limit=0)
    assert {v[0] for v in verdicts(spark, strict, found)} == {1}
    nowhere = hosted.Hosted(hosted.Http("http://127.0.0.1:9", "k", 0.5))
    assert {v[4] for v in verdicts(spark, nowhere, rows(["x"], 1))} == {"jev_fallback_http"}


def test_a_document_stops_at_its_first_failure(spark, stub):
    stub.seen.clear()
    judge = hosted.Hosted(hosted.Http(stub.url, "k"), limit=0)
    got = verdicts(spark, judge, rows(["text"] * 55 + ["fail"] + ["text"] * 100, 7))
    assert len(got) == 156 and {v[4] for v in got} == {"jev_fallback_http"}
    assert [len(x[2]["state"]) for x in stub.seen] == [50, 50] and judge.log[0].count() == 2


def test_breaker_and_gate(spark, stub):
    stub.seen.clear()
    judge = hosted.Hosted(hosted.Http(stub.url, "k"), limit=2, cool_off=3600.0)
    got = verdicts(spark, judge, [r for d in range(5) for r in rows(["fail"], d)])
    assert [v[4] for v in got] == ["jev_fallback_http"] * 2 + ["jev_fallback_breaker_open"] * 3 and len(stub.seen) == 2
    assert judge.usage().count() == 2
    stub.seen.clear()
    gated = hosted.by_name("jev_gated", hosted.from_environment({"LEAFWISE_JUDGE_KEY": "k", "LEAFWISE_JUDGE_URL": stub.url, "LEAFWISE_JUDGE_MODEL": "m"}))
    got = verdicts(spark, gated, rows(["text", "text"], 1) + rows(["scan", "text"], 2, flagged=[0]))
    assert [v[4] for v in got] == ["jev_not_escalated"] * 2 + ["jev_needs_ocr", "jev_clear"] and [x[2]["model"] for x in stub.seen] == ["m"] and gated.name == "jev_gated"
    now = [0.0]
    breaker = judges.Breaker(2, 10.0, lambda: now[0])
    for ok in (False, True, False, False):
        breaker.note(ok)
    assert breaker.is_open()
    now[0] = 10.0
    assert not breaker.is_open() and breaker.run == 0


def test_judges_that_cannot_be_used():
    assert hosted.from_environment({"LEAFWISE_JUDGE_KEY": " "}) is None and hosted.from_environment({}, key="k").model == hosted.MODEL
    with pytest.raises(RuntimeError):
        hosted.by_name("jev", None)
    with pytest.raises(KeyError):
        hosted.by_name("nobody", None)


class Odd(judges.Heuristic):
    """A judge that breaks the contract in a way of the document's."""

    def judge(self, found):
        good = super().judge(found)
        none = good.where("NOT (doc_id = 1 AND page = 0)").where("NOT (doc_id = 2 AND page = 1)")
        return none.unionByName(good.where("doc_id = 2 AND page = 0")).unionByName(good.where("doc_id = 3 AND page = 0").withColumn("page", F.lit(9)))


def test_a_judge_that_leaves_out_repeats_or_invents_pages(spark):
    lines = lambda page: fixtures.body_lines("test", page, 8)
    files = spark.createDataFrame([(d, pdf.write("tst", lines)) for d in (1, 2, 3, 4)], "doc_id long, content binary")
    got = {r.doc_id: (r.kind, r.reason) for r in api.decide(files, judge=Odd()).collect()}
    assert got == {d: ("bypass", "classifier_unavailable") for d in (1, 2, 3)} | {4: ("route", "mixed_split")}
    docs = spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 0)], "doc_id long, page_count int")
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 0), (3, 0), (3, 2)], "doc_id long, page int")
    assert {r.doc_id: r.status for r in evidence.contract(docs, pages).collect()} == {1: "ok", 2: "duplicate", 3: "out_of_range", 4: "ok"}


def test_split_subsets_are_read_and_billed_alike(spark):
    lines = lambda page: [f"text of page {page}"]
    # The host tells pages by their order in the tree: w pages carry their stamp, so each page's own features show which it is.
    files = spark.createDataFrame([(1, pdf.write("tiit", lines)), (2, pdf.write("itwi", lines))], "doc_id long, content binary")

    def host(model, content, pages):
        doc = pdf.parse(content)
        features = [pdf.page_features(doc, n) for n in doc.pages]
        asked = pages if pages is not None else range(len(features))
        return {"pages": [{"index": p, "markdown": f"{features[p]['text']}/{features[p]['image_pixels']}"} for p in asked], "model": model}

    def told(**more):
        pages, docs = api.run(files, host, **more)
        return sorted((r.doc_id, r["index"], r.markdown) for r in pages.collect()), sorted((r.doc_id, r.pages_processed, r.error) for r in docs.collect())

    whole, subset = told(), told(split_subset=True)
    assert whole == subset and [p[:2] for p in whole[0]] == [(d, i) for d in (1, 2) for i in range(4)] and [d[1] for d in whole[1]] == [4, 4]


def test_previews_and_blank_values(spark):
    from leafwise.functions import columns as C

    shown = lambda text: spark.range(1).select(C.preview(F.lit(text))).first()[0]
    assert shown("\n\t\n  a line \nb") == "  a line " and shown(" \n\r\nx\r\n") == "x" and shown(" \t") == "(empty)" and shown("y" * 90) == "y" * 80 + "…"
    assert spark.range(1).select(C.blank_to_null(F.lit("\t\n")).alias("a"), C.blank_to_null(F.lit(" m ")).alias("b")).first() == (None, " m ")


def test_bench_runs_every_ready_judge(spark, stub, tmp_path, monkeypatch, capsys):
    lines = lambda page: fixtures.body_lines("test", page, 8)
    names = {"a.pdf": ("tst", [1], "Synthetic"), "b.pdf": ("ss", [0, 1], "adversarial"), "c.pdf": ("tt", [], "Synthetic")}
    for name, (kinds, _, _) in names.items():
        (tmp_path / name).write_bytes(pdf.write(kinds, lines))
    documents = [{"file": n, "source": s, "page_count": len(k), "needs_ocr": t} for n, (k, t, s) in names.items()] + [{"file": "gone.pdf", "source": "x", "page_count": 1, "needs_ocr": []}]
    (tmp_path / "manifest.json").write_text(json.dumps({"documents": documents}))
    monkeypatch.setattr(cli, "session", lambda: spark)
    stub.seen.clear()
    args = ["bench", "--corpus", str(tmp_path / "manifest.json"), "--judge", "jev", "--repeat", "2", "--judge-url", stub.url, "--judge-key", "k", "--cost-per-million-input-tokens", "10"]
    assert cli.main(args) == 1
    text = capsys.readouterr().out
    assert "judges   heuristic (baseline), jev" in text and "scored   3 of 4 document(s), 1 excluded" in text and "repeat   2" in text and "== jev" in text and "FAILED gone.pdf" in text
    assert "accuracy" in text.split("== jev")[1] and "Brier" in text.split("== jev")[1] and "degenerate: constant 1.000" in text.split("== jev")[0]
    assert "3 call(s), 700 input" in text and len(stub.seen) == 6
    assert cli.main([*args, "--json", "--out", str(tmp_path / "report.json")]) == 1
    got = json.loads((tmp_path / "report.json").read_text())
    assert got["judges"] == ["heuristic", "jev"] and {x["judge"] for x in got["errors"]} == {"heuristic", "jev"} and got["repeat"] == 2
    assert cli.main(["bench", "--corpus", str(tmp_path / "manifest.json"), "--judge", "jev"]) == 1
    assert "SKIPPED jev: no API key" in capsys.readouterr().out


def test_run_writes_result_metadata_and_judge(spark, stub, tmp_path, monkeypatch, capsys):
    lines = lambda page: ["fail"] if page == 2 else fixtures.body_lines("test", page, 8)
    (tmp_path / "a.pdf").write_bytes(pdf.write("ttt", lines))
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["run", str(tmp_path / "a.pdf"), "--judge", "jev", "--judge-url", stub.url, "--judge-key", "k", "--out", str(tmp_path / "out")]) == 0
    row = spark.read.json(str(tmp_path / "out")).first()
    assert row.judge.name == "jev" and [(f.reason, f.pages) for f in row.judge.fallbacks] == [("jev_fallback_http", 3)]
    assert len(row.result.pages) == 3 and row.result.model == conf.LOCAL_MODEL and row.metadata.reason == "text_layer"
    capsys.readouterr()


def test_bytes_wrap():
    from leafwise.operators.report import wrap

    assert wrap("aa bb cc", 5, "") == "aa bb\ncc" and wrap("éé bb", 6, "") == "éé\nbb" and wrap("x" * 9 + " y", 4, "") == "x" * 9 + "\ny"
