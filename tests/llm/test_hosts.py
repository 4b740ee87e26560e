"""Rules and the two ranks against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafwise.llm import hosts

URLS = {
    "http://x.org/": ("x.org", "/", "org/", "allow"), "https://A.Example.ORG/es/1?q": ("a.example.org", "/es/1", "example.org/es/", "block"), "ftp://example.org/en/12#f": ("example.org", "/en/12", "example.org/en/1", "block"),
    "http://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"), "http://x.com/fr/a://b": ("x.com", "/fr/a://b", "com/fr/", "allow"), "http://x.com/de/": ("x.com", "/de/", "com/de/", "block"), "http://org": ("org", "", None, None),
    "http://x.net?u=/": ("x.net", "", None, None), "no url": ("", "", None, None), "": ("", "", None, None), None: ("", "", None, None), "a://b\nc/d\ne?f": ("b\nc", "/d\ne", None, None), "http://É.org/": ("É.org", "/", "org/", "allow"),
}


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    got = {r.page_id: r for r in hosts.judge(pages).collect()}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == (verdict or "allow") or rule is None


def test_ranks_equal_a_linear_solve(spark):
    draw = np.random.default_rng(0)
    n, names = 12, [f"h{i}" for i in range(12)]
    weight = draw.integers(0, 3, (n, n)) * (draw.random((n, n)) < 0.3)
    np.fill_diagonal(weight, 0)
    seeds = [(names[i], int(draw.integers(0, 3)), int(draw.integers(0, 3))) for i in range(n)]
    edges = spark.createDataFrame([(names[i], names[j], float(weight[i, j])) for i in range(n) for j in range(n) if weight[i, j]], "src string, dst string, weight double")
    got = {r.host: (r.trust, r.distrust) for r in hosts.propagate(spark.createDataFrame(seeds, "host string, trusted long, blocked long"), edges, rounds=60).collect()}
    for k, matrix in ((1, weight), (2, weight.T)):
        out = matrix.sum(axis=1, keepdims=True)
        step = np.divide(matrix, out, out=np.zeros((n, n)), where=out > 0)
        seed = np.array([s[k] for s in seeds], float)
        rank = np.linalg.solve(np.eye(n) - hosts.DAMPING * step.T, seed / seed.sum())
        rank /= rank.sum()
        for i, name in enumerate(names):
            assert (got.get(name, (None, None))[k - 1] or 0.0) == pytest.approx(rank[i], abs=1e-9)


def test_distrust_goes_against_links(spark):
    link = '<a href="http://bad.com/x">'
    rows = [(1, "http://bad.com/de/1", None), (2, "http://farm.net/", link + '<a href = \'http://bad.com/y\'>'), (3, "http://good.org/", '<a HREF=http://friend.net/>'), (4, "http://friend.net/", "<p>no link</p>"), (5, "http://lone.net/", None), (5, "http://lone.net/", None)]
    got = hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.verdict) for r in got) == [(1, "block"), (2, "block"), (3, "allow"), (4, "allow"), (5, "allow"), (5, "allow")]
    assert hosts.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ties_between_rules(spark):
    rules = (("allow", "org/ab"), ("block", "x.org/"), ("block", "org/aa"))
    pages = spark.createDataFrame([(1, "http://x.org/ab", None), (2, "http://y.org/aa", None)], "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in hosts.judge(pages, rules).collect()} == {1: ("x.org/", "block"), 2: ("org/aa", "block")}


def test_distrust_goes_as_far_as_the_links(spark):
    rows = [(0, "http://h0.com/de/1", None)] + [(i, f"http://h{i}.net/", f'<a href="//h{i - 1}.{"net" if i > 1 else "com"}/x">') for i in range(1, 13)]
    got = {r.page_id: r for r in hosts.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: r.verdict for k, r in got.items()} == {i: "block" for i in range(13)}
    rank = [hosts.DAMPING**i for i in range(13)]
    assert [got[i].distrust for i in range(13)] == pytest.approx([x / sum(rank) for x in rank], rel=1e-5)


def test_clashing_columns_long_pages_and_empty_tables(spark):
    long = "<p>" + "x" * 3_000_000 + '<a href="http://bad.net/x">l</a>'
    rows = [(1, "http://Deep.example.org/es/1", None, "a"), (2, "http://far.net/p?q", long, "b"), (2, "http://far.net/p?q", long, "b"), (3, None, "", None), (None, "no host", "<a href=//bad.net>", "c"), (4, "http://bad.net/", "", "d"), (5, "http://x.com/de/y", '<a href="http://far.net/">', "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").withColumn("verdict", F.lit("clash")).withColumn("rank", F.lit(1)).withColumn("kind", F.lit(1))
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages).collect())
    assert got == [(0, "", "", None, "allow"), (1, "deep.example.org", "/es/1", "example.org/es/", "block"), (2, "far.net", "/p", None, "allow"), (2, "far.net", "/p", None, "allow"), (3, "", "", None, "allow"), (4, "bad.net", "/", None, "allow"), (5, "x.com", "/de/y", "com/de/", "block")]
    assert hosts.judge(pages.limit(0)).count() == 0
