"""Targets, copies and the prefix sum against a plain computation."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from leafwise.llm import mixing


def shares(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped: set = set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        total = sum(w[s] for s in names if s not in capped)
        target = {s: Fraction(most * sizes[s]) if s in capped else Fraction(rest * w[s], total) for s in names}
        more = {s for s in names if s not in capped and target[s] > most * sizes[s]}
        if not more:
            return target
        capped |= more


def docs_of(spark, sizes, words=7):
    rows, k = [], 0
    for source, size in sizes.items():
        while size > 0:
            n = min(size, 1 + (k * 37) % words)
            rows.append((k, " ".join(["w"] * n), source))
            size, k = size - n, k + 1
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 500, "B": 40, None: 300}, {"a": 50}, {"a": 10, "b": 10, "c": 10}, {"é": 5, "z": 2000, "y": 1, "x": 1}])
def test_targets_and_takes(spark, sizes):
    rows = mixing.systematic_copies(docs_of(spark, sizes)).collect()
    want = shares(sizes)
    for source, size in sizes.items():
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {size} and {round(r.target, 6) for r in own} == {round(float(want[source]), 6)}
        taken = sum(r.copies * r["size"] for r in own)
        assert abs(taken - float(want[source])) <= 7 + 1
        rate = want[source] / size
        assert all(abs(r.copies - rate) < 1 and r.copies <= 3 for r in own)


def test_cells_and_reruns_agree(spark):
    docs = docs_of(spark, {"a": 3000, "b": 90})
    key = lambda df: sorted((r.doc_id, r.copies) for r in df.collect())
    assert key(mixing.systematic_copies(docs)) == key(mixing.systematic_copies(docs.repartition(7)))
    small = mixing.systematic_copies(docs, cell_rows=20).where("source = 'a'")
    size, target = 3000, small.first().target
    assert abs(small.agg(F.sum(F.col("copies") * F.col("size"))).first()[0] - target) < 60 and size == small.first().source_size


def test_edges(spark, table):
    docs = table([(1, None, "en", None, 1), (2, "", "en", "a", 0), (3, "x y", None, "a", 1), (3, "x y", None, "a", 1), (None, "u v w", "en", None, 9)])
    rows = mixing.systematic_copies(docs).collect()
    assert len(rows) == 5 and {r["size"] for r in rows} == {0, 2, 3}
    mixed = mixing.mix(docs.withColumnRenamed("lang", "copies"))
    assert mixed.columns == ["doc_id", "text", "copies", "source", "n_chars"] and mixed.count() >= 2
    assert mixing.systematic_copies(table([])).count() == 0
    empty = mixing.systematic_copies(table([(1, None, None, "a", 1)])).first()
    assert (empty.copies, empty.target) == (0, 0.0)


def test_repeated_rows_are_taken_as_often_as_they_count(spark, table):
    rows = [(1, "a b c", "en", "a", k % 3) for k in range(40)] + [(k, "x y", "en", "b", k) for k in range(2, 40)] + [(None, "u v", None, None, None)] * 9
    docs = table(rows)
    want = {(r.doc_id, r.source): r.n for r in mixing.systematic_copies(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if r.n}
    mixed = mixing.mix(docs).collect()
    got = {}
    for r in mixed:
        got[r.doc_id, r.source] = got.get((r.doc_id, r.source), 0) + 1
    assert got == want and sum(r.doc_id == 1 for r in mixed) < 40
