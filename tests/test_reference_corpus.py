"""The 155-page corpus gives the published scores, and real files go through the whole router."""

import pytest
from pyspark.sql import functions as F

from leafwise import api, fixtures
from leafwise import config as conf
from leafwise.operators import bench, policy, scoring
from leafwise.sources import pdf


@pytest.fixture(scope="module")
def corpus(spark):
    return fixtures.documents(spark).cache()


def test_published_heuristic_score(corpus):
    whole = scoring.add(scoring.score_lists(corpus).withColumn("all", F.lit(1)), "all")
    row = scoring.with_rates(scoring.with_cost(scoring.with_totals(whole), 1.0)).first()
    assert (row.documents, row.pages, row.truly_needs_ocr, row.exact) == (19, 155, 87, 11)
    assert (row.correct_ocr, row.correct_local, row.missed_ocr, row.wasted_ocr) == (59, 59, 28, 9)
    assert [round(x, 3) for x in (row.precision, row.recall, row.f1)] == [0.868, 0.678, 0.761]
    assert (row.naive, row.routed, row.ideal, row.saving, row.ceiling_saving, row.saving_beyond_ceiling_pages) == (155, 68, 87, 87, 68, 19)
    assert round(row.routed_share, 3) == 0.439


def test_groups_and_caveat(corpus):
    s = scoring.score_lists(corpus).withColumn("judge", F.lit("heuristic"))
    got = {r.source: (r.documents, r.exact) for r in bench.by_source(s, "judge").collect()}
    assert got == {"synthetic": (10, 10), "adversarial": (9, 1), None: (19, 11)}
    assert [r.source for r in bench.synthetic_caveats(bench.by_source(s, "judge")).collect()] == ["synthetic"]


@pytest.mark.parametrize("variant, expected", [
    ("premium", {"empty": "text_layer", "single_image": "scanned", "mixed": "mixed_split", "text": "text_layer"}),
    ("no_split", {"mixed": "mixed_unsplit", "scanned": "scanned"}),
    ("strict", {"empty": "low_confidence", "single_text": "text_layer", "mixed": "low_confidence"}),
])
def test_golden_plans(corpus, variant, expected):
    from leafwise.functions import columns as C

    n, pages = F.col("page_count"), F.col("flagged")
    label = C.label(F.col("reported"), pages, n)
    c = corpus.withColumn("pages_needing_ocr", pages).withColumn("confidence", F.when(n == 0, F.lit(0.9).cast("float")).otherwise(C.document_confidence(label, C.ratio(n - F.size(pages), n)))).withColumn("is_complex_layout", F.lit(False))
    got = {r.document: r.reason for r in policy.plan(c, conf.VARIANTS[variant]).collect()}
    assert {k: got[k] for k in expected} == expected


def test_files_end_to_end(spark):
    lines = lambda page: fixtures.body_lines("test", page, 8)
    contents = [(1, pdf.write("tst", lines)), (2, pdf.write("ss", lines)), (3, pdf.write("tt", lines)), (4, b"plain text"), (5, b"%PDF-broken")]
    files = spark.createDataFrame(contents, "doc_id long, content binary")
    decided = {r.doc_id: r for r in api.decide(files).collect()}
    assert {k: r.reason for k, r in decided.items()} == {1: "mixed_split", 2: "scanned", 3: "text_layer", 4: "not_pdf", 5: "classifier_unavailable"}
    assert decided[1].pages_needing_ocr == [1] and [leg.pages for leg in decided[1].legs] == [[0, 2], [1]]

    def host(model, content, pages):
        if pages == [1]:
            raise RuntimeError("down")
        return {"pages": [{"index": p, "markdown": f"{model}"} for p in (pages or [0, 1])], "model": "", "doc_size_bytes": len(content)}

    pages, docs = api.run(files, host, default_model="backup")
    done = {r.doc_id: r for r in docs.collect()}
    assert done[1].fallback_reason == "leg_failed" and done[1].routed_model == "backup" and done[1].error is None
    assert done[2].fallback_reason is None and done[4].routed_model == "backup" and done[3].model == conf.LOCAL_MODEL
    text = {(r.doc_id, r["index"]): r.markdown for r in pages.collect()}
    assert text[3, 0].split("\n") == lines(0) and text[1, 0] == "backup"


def test_split_keeps_order_and_text():
    lines = lambda page: [f"page {page} (of some)"]
    cut = pdf.split(pdf.write("ttst", lines), [3, 0, 2])
    doc = pdf.parse(cut)
    got = [pdf.page_features(doc, n) for n in doc.pages]
    assert [g["text"] for g in got] == ["page 3 (of some)", "page 0 (of some)", ""] and got[2]["image_pixels"] == 800_000
    for bad in ([], [4], [-1]):
        with pytest.raises(pdf.PdfError):
            pdf.split(cut, bad)
