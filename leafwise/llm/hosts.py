"""URL filters: rules for hosts and paths, and link-graph propagation for all that no rule decides.

Hosts are the nodes; links between them and the bond of a host with the domain above it are the edges. Trust starts at the
hosts of pages that rules allow and follows the links; distrust starts at the hosts of pages that rules block and goes
against them, to those who link there. Both are personalised PageRanks; a host is blocked where its
distrust, in units of what the seeds got, exceeds its trust by the threshold.

Everything is expressions, joins and aggregates. Links are summed by pair of hosts before any
other step, so a host with a third of all pages counts as one node; the last join, from hosts to
pages, is left to the skew handling of the adaptive planner, for the other side has one row a host.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: The contract's rules: (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
DAMPING, WRITE_EVERY = 0.6, 4
#: Ranks are settled when no host's changes by more than this part of itself, and no new host is reached.
SETTLED = 1e-6
#: Rounds of the SQL, enough for the shallow graphs of the tables.
SQL_ROUNDS = 8
#: Distrust over trust from which a host is blocked.
THRESHOLD = 1.0
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first :// to the next / ? # or the end, A-Z lower-cased; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to the next ? # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of rules of one length block goes first, then the lesser text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, weight): links from pages to other hosts, with a scheme or from // on, summed by pair. A null url or html has none."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1)).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to"))).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def family_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, weight): each host and the domain above it, in both ways, where both are hosts. hosts: (host), distinct."""
    above = hosts.where("instr(host, '.') > 0").select("host", F.expr("substring(host, instr(host, '.') + 1)").alias("up"))
    both = above.join(hosts.select(F.col("host").alias("up")), "up")
    return both.select(F.explode(F.array(F.struct(F.col("host").alias("src"), F.col("up").alias("dst")), F.struct(F.col("up").alias("src"), F.col("host").alias("dst")))).alias("e")).select("e.src", "e.dst", F.lit(1.0).alias("weight"))


def propagate(seeds: DataFrame, edges: DataFrame, *, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, trust, distrust), both 1 in sum. seeds: (host, trusted, blocked), weights >= 0; edges: (src, dst, weight).

    A dangling host's mass goes back to the seeds, which is the same as scaling the walk without it. Hosts in
    neither table and such as nothing reaches do not appear. Without seeds of a kind that rank is null. Without a number
    of rounds they go on until the ranks are settled: ranks only grow, so this takes the depth of the graph and some thirty rounds.
    """
    edges = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    flows = edges.join(out, "src").select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("weight") / F.col("total")).alias("part"))
    flows = flows.unionByName(edges.join(into, "dst").select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("weight") / F.col("total")).alias("part")))
    flows = written(flows, "hosts-flows")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trusted").cast("double").alias("seed")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").cast("double").alias("seed")))).alias("s"))
    sums = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    whole = {"trust": float(sums["t"] or 0), "distrust": float(sums["b"] or 0)}
    scale = F.when(F.col("s.kind") == "trust", F.lit(whole["trust"] or 1.0)).otherwise(F.lit(whole["distrust"] or 1.0))
    start = written(start.where("s.seed > 0").select("host", F.col("s.kind").alias("kind"), ((1 - damping) * F.col("s.seed") / scale).alias("rank")), "hosts-seeds")
    rank = start
    if not flows.isEmpty():
        before = rank
        for k in itertools.count() if rounds is None else range(rounds):
            moved = flows.join(rank, ["kind", "host"]).select(F.col("to").alias("host"), "kind", (damping * F.col("part") * F.col("rank")).alias("rank"))
            rank = start.unionByName(moved).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
            if k % WRITE_EVERY == WRITE_EVERY - 1:
                rank = written(rank, "hosts-rank")
                if rounds is None:
                    old = before.select("kind", "host", F.col("rank").alias("old"))
                    if rank.join(old, ["kind", "host"], "left").where(F.col("old").isNull() | (F.col("rank") - F.col("old") > SETTLED * F.col("rank"))).isEmpty():
                        break
                    before = rank
    got = {r["kind"]: r["s"] for r in rank.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
    sums_of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank") / F.lit(got.get(kind) or 1.0)))
    return rank.groupBy("host").agg(sums_of("trust").alias("trust"), sums_of("distrust").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, *, edges: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, otherwise: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust; one row per row of pages.

    The verdict is the rule's, else block where distrust > threshold * trust, else allow; `otherwise` for hosts
    that neither reaches and for pages without a host. edges: (src, dst, weight) beside those found in pages.
    """
    slim = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    slim = slim.withColumn("rule", rule).withColumn("by_rule", verdict)
    hosts = slim.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("by_rule") == "allow", 1)).alias("trusted"), F.count(F.when(F.col("by_rule") == "block", 1)).alias("blocked"))
    hosts = written(hosts, "hosts")
    links = host_edges(pages, url_col, html_col).unionByName(family_edges(hosts.select("host")))
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")))
    ranks = propagate(hosts, links).withColumnRenamed("host", "host_")
    joined = slim.join(ranks, F.col("host") == F.col("host_"), "left")
    t, d = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    found = F.when(d > threshold * t, "block").when(t > 0, "allow").otherwise(otherwise)
    return joined.select("page_id", "host", "path", "rule", F.coalesce("by_rule", found).alias("verdict"), "trust", "distrust")


def _oracle() -> str:
    """The same in SQL, a round a common table expression."""
    rules = sorted(RULES, key=lambda r: (-len(r[1]), r[0] != "block", r[1]))
    case = lambda value: "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR host LIKE '%.{r.partition('/')[0]}') AND starts_with(path, '/{r.partition('/')[2]}') THEN '{value(k, r)}'" for k, r in rules) + " END"
    steps = ",\n".join(
        f"r{i + 1} AS (SELECT host, kind, sum(rank) AS rank FROM (SELECT * FROM r0 UNION ALL SELECT f.dst, f.kind, {DAMPING} * f.part * r.rank FROM flows f JOIN r{i} r ON f.kind = r.kind AND f.host = r.host) GROUP BY ALL)" for i in range(SQL_ROUNDS)
    )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {case(lambda k, r: r)} AS rule, {case(lambda k, r: k)} AS by_rule FROM p),
h AS (SELECT host, count(*) FILTER (by_rule = 'allow') AS trusted, count(*) FILTER (by_rule = 'block') AS blocked FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*[a-z][a-z0-9+.\-]*://([^"''\s<>/?#]+)', 1)) AS dst FROM p),
e AS (SELECT src, dst, sum(weight) AS weight FROM (
  SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst, 1.0::DOUBLE AS weight FROM l WHERE src <> '' AND src <> translate(dst, '{UPPER}', '{LOWER}')
  UNION ALL SELECT a.host, b.host, 1.0 FROM h a JOIN h b ON instr(a.host, '.') > 0 AND substr(a.host, instr(a.host, '.') + 1) = b.host
  UNION ALL SELECT b.host, a.host, 1.0 FROM h a JOIN h b ON instr(a.host, '.') > 0 AND substr(a.host, instr(a.host, '.') + 1) = b.host) GROUP BY ALL),
flows AS (SELECT 'trust' AS kind, src AS host, dst, weight / sum(weight) OVER (PARTITION BY src) AS part FROM e
  UNION ALL SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM e),
r0 AS (SELECT host, 'trust' AS kind, {1 - DAMPING} * trusted / (SELECT sum(trusted) FROM h) AS rank FROM h WHERE trusted > 0
  UNION ALL SELECT host, 'distrust', {1 - DAMPING} * blocked / (SELECT sum(blocked) FROM h) FROM h WHERE blocked > 0),
{steps},
k AS (SELECT host, sum(rank) FILTER (kind = 'trust') / (SELECT sum(rank) FROM r{SQL_ROUNDS} WHERE kind = 'trust') AS t,
  sum(rank) FILTER (kind = 'distrust') / (SELECT sum(rank) FROM r{SQL_ROUNDS} WHERE kind = 'distrust') AS d FROM r{SQL_ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(by_rule, CASE WHEN coalesce(d, 0) > {THRESHOLD} * coalesce(t, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN k ON j.host = k.host
"""


ORACLE = _oracle()
