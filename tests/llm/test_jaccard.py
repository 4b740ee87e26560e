"""The join against brute force: components, sizes, no link lost."""

import random
import re

import numpy as np
import pytest

from leafwise.llm import jaccard


def brute(rows, width, part, whole):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and whole * both >= part * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        kin = [rows[k][0] for k in range(len(rows)) if find(k) == find(i) and rows[k][0] is not None]
        out.append((doc_id, len(sets[i]), min(kin) if kin else None))
    return out


def corpus(seed, families=12, copies=6, passage=True):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [draw.choice(words) for _ in range(60)]
    rows = []
    for _ in range(families):
        base = [draw.choice(words) for _ in range(draw.choice([3, 5, 8, 20, 80, 300, 900]))]
        if passage and draw.random() < 0.5:
            base += shared
        for _ in range(draw.randint(1, copies)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, max(1, len(base) // 60)])):
                text[draw.randrange(len(text))] = draw.choice(words)
            rows.append((draw.randrange(10**6), " ".join(text)))
    return rows


@pytest.mark.parametrize("seed, width, part", [(1, 4, 85), (2, 5, 80), (3, 4, 85), (4, 2, 60)])
def test_components_equal_brute_force(spark, seed, width, part):
    rows = corpus(seed) + [(None, "null id alone"), (7, None), (8, ""), (9, "  \n "), (10, "Two Words"), (11, "two words"), (12, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, width=width, part=part, whole=100).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, width, part, 100), key=repr)


def test_rows_that_repeat_id_and_text(spark, monkeypatch):
    """Such rows send their text to a candidate once; ids 0 and null are told apart."""
    long, sent = [f"w{i}" for i in range(80)], []
    near, other = " ".join([*long[:-1], "end"]), " ".join(f"v{i}" for i in range(80))
    rows = [(None, " ".join(long))] * 40 + [(0, near)] * 40 + [(5, near)] + [(0, other), (9, other + " z"), (None, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    plain = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, nodes, docs, *more: sent.append(docs.groupBy("doc_id", "mark").count().where("count > 1").count()) or plain(pairs, nodes, docs, *more))
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, width=4, part=85).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 4, 85, 100), key=repr)
    assert sent and not any(sent)


def test_one_large_group_of_near_copies(spark):
    draw = random.Random(5)
    base = [f"x{draw.randrange(10**5)}" for _ in range(150)]
    rows = []
    for i in range(300):
        text = list(base)
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(150)] = f"y{draw.randrange(10**5)}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(docs, width=4, part=85).collect())
    assert got == brute(rows, 4, 85, 100)


def test_few_elements_in_few_pieces():
    """Sets whose elements fall into one piece still share a key with their kin."""
    measure = jaccard.Measure(85, 100)
    draw = np.random.default_rng(0)
    counts = np.zeros(1 << jaccard.FEWEST, np.uint32)
    for n in range(6, 40):
        for _ in range(30):
            high = np.uint64(draw.integers(0, 2**31)) << np.uint64(32)
            a = np.unique(high + draw.integers(0, 2**32, n).astype(np.uint64))
            b = np.unique(np.append(a[:-1], high + np.uint64(draw.integers(0, 2**32)))) if draw.random() < 0.5 else a[1:]
            both = len(np.intersect1d(a, b))
            if measure.linked(both, len(a), len(b)) and not np.array_equal(a, b):
                who, key = jaccard.pieces([a, b], counts, measure)
                assert set(key[who == 0]) & set(key[who == 1])


def test_lower_bound():
    draw = np.random.default_rng(1)
    for _ in range(200):
        a, b = np.unique(draw.integers(0, 500, draw.integers(1, 300)).astype(np.uint64)), np.unique(draw.integers(0, 500, draw.integers(1, 300)).astype(np.uint64))
        size = min(len(jaccard.sketch(a)), len(jaccard.sketch(b)))
        gap = int(np.bitwise_count(jaccard.fold(jaccard.sketch(a), size) ^ jaccard.fold(jaccard.sketch(b), size)).sum())
        assert gap <= len(np.setxor1d(a, b))


def test_one_of_each_stays(spark, table):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(3, long, "en", "a", 1), (2, long + " z", "en", "b", 1), (2, long + " z", "en", "b", 1), (5, None, None, None, None), (6, "", "en", "a", 0), (9, "other text entirely", "fr", "a", 2)]
    kept = jaccard.one_of_each(table(rows).withColumnRenamed("n_chars", "label"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 9] and kept.columns == ["doc_id", "text", "lang", "source", "label"]
    assert jaccard.classes(table([])).count() == 0


def test_long_texts_in_stretches(monkeypatch):
    text = " ".join(f"word{i % 977}" for i in range(20_000)) + " " + "q" * 9000
    want = jaccard.shingle_sets([text, "a b"], 4)
    monkeypatch.setattr(jaccard, "BYTES_AT_ONCE", 5000)
    got = jaccard.shingle_sets([text, "a b"], 4)
    assert all(np.array_equal(x, y) for x, y in zip(want, got, strict=True))


def test_ids_of_sets_and_counters():
    x = np.arange(5, dtype=np.uint64)
    assert jaccard.node_of(x) != jaccard.node_of(x, 1) and len(set(jaccard.node_of(x) + jaccard.node_of(x[:4]))) == 4
    assert jaccard.counters_for(0) == jaccard.counters_for(500 << 20) == 1 << 20
    assert jaccard.counters_for(8 << 30) == 1 << 24 == jaccard.counters_for(100 << 40)


def test_tables_of_an_application_are_discarded(spark):
    import os

    from leafwise.llm import common

    table = common.written(spark.range(3).toDF("id"), "some")
    folder = common.own_dir(spark).removeprefix("file://")
    assert os.path.isdir(table.written_to.removeprefix("file://"))
    common.forget(table)
    assert not os.path.exists(table.written_to.removeprefix("file://")) and os.path.isdir(folder)
