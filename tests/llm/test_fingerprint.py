"""Fingerprints against a plain computation; edits are located."""

import hashlib

import pytest
from pyspark.sql import functions as F

from leafwise.llm import fingerprint as fp


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def short(digests):
    return [x[: fp.DIGITS] for x in digests]


def plain(text):
    """Fingerprint, set of leaves and section digests of a text."""
    leaves = [[md5(p[i : i + fp.PIECE]) for i in range(0, len(p), fp.PIECE)] for p in text.split("\n")] if text else []
    whole = [md5("".join(x)) for x in leaves]
    branches = [md5("".join(whole[i : i + fp.PARAGRAPHS])) for i in range(0, len(whole), fp.PARAGRAPHS)]
    flat = short(x for p in leaves for x in p)
    return ":".join([md5(f"{len(leaves)}:" + "".join(branches)), ",".join(short(branches)), ",".join(flat)]), set(flat), branches


def expected(rows):
    rows = sorted(((i if i is not None else -(1 << 63)), t or "") for i, t in rows)
    out = []
    for k, (i, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + other[:q]
        (own, a, s), (new, b, t), (_, c, _) = plain(text), plain(edited), plain(other)
        differ = [str(i) for i in range(max(len(s), len(t))) if s[i : i + 1] != t[i : i + 1]]
        like = lambda x, y: 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))
        out.append((None if i == -(1 << 63) else i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, like(a, b), like(a, c), ",".join(differ)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows_a_range", [2, 2_000])
def test_equal_to_the_plain_computation(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "ROWS_A_RANGE", rows_a_range)
    rows = [(i * i - 50, f"Line {i} é👍\n" * (i % 5) + "x" * (i * 13)) for i in range(40)] + [(5000, None), (5001, ""), (5002, "one"), (5003, "\n\n"), (6000, "same"), (6000, "same"), (6000, "other"), (None, "no id"), (7000, "a\nb\n" * 9), (7001, "\n" * 40 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("next_text", F.lit("clash")).repartition(4)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.edited_sections) for r in fp.fingerprints(docs).collect()), key=repr)
    assert got == expected(rows)


def test_one_document_and_none(spark):
    docs = spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")
    row = fp.fingerprints(docs).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and fp.fingerprints(docs.limit(0)).count() == 0


def test_edits_are_located(spark):
    lines = [f"paragraph {i}" for i in range(40)]
    changed = [*lines[:20], "new", *lines[21:]]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(changed))], "a string, b string")
    marks = df.select(fp.sections(fp.pieces(F.col("a"))).alias("a"), fp.sections(fp.pieces(F.col("b"))).alias("b"))
    assert marks.select(fp.differing_sections(F.col("a"), F.col("b"))).first()[0] == [2]
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(["other"] * 40))], "doc_id long, text string")
    assert [r.edited_sections for r in fp.fingerprints(docs).orderBy("doc_id").collect()] == ["3,4,5,6", "3,4"]
