"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected `target / source_size` times. The documents of a source stand in
one order; their expected copies are summed along it, one random offset of the source is added, and a document is
emitted once for each integer boundary that its stretch crosses. Copies thus differ by less than one
from what is expected, and as the order follows the size, the words taken follow the target.

The prefix sum is distributed: documents fall into cells of a few thousand (source, size class, hash), a window
numbers them inside a cell, and the counts of the cells before it are added. No task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, unused, written

SEED = "mix"
CELL_ROWS = 4_096
MOST_COPIES = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(value: Column, digits: int) -> Column:
    """A number from the first hex digits of an MD5."""
    return F.conv(F.substring(F.md5(value.cast("string").cast("binary")), 1, digits), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources by code point, null last, get the weights in turn and share the sum of all sizes by weight. A target
    stops at `most` times the source's size; what is left over is shared again by weight until none is above.
    Sources of size 0 have target 0. Rounds are at most as many as sources; each is one row to the driver.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(w) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    table = written(sizes.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * most
    capped = F.lit(False)
    before = -1
    rest, wsum = 0, 0
    while True:
        row = table.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(capped, cap)).alias("kept"),
            F.sum(F.when(~capped, F.col("weight"))).alias("wsum"), F.count(F.when(capped, 1)).alias("n"),
        ).first()
        rest, wsum = (row.total or 0) - (row.kept or 0), row.wsum or 0
        if row.n == before or not wsum:
            break
        before = row.n
        capped = F.lit(wsum).cast("decimal(38,0)") * cap.cast("decimal(19,0)") < F.lit(rest).cast("decimal(19,0)") * F.col("weight").cast("decimal(6,0)")
        if rest == 0:
            break
    share = (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(wsum or 1))
    return table.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def systematic_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                      weights: tuple[int, ...] = (1, 2, 3), seed: str = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per document: id, source, mark (hash of the text), size, source_size, target, copies.

    Null texts have size 0; documents of a source of size 0 are taken 0 times. Rows that repeat an id count as
    documents of their own. A null source is a source. An empty table gives an empty result.
    """
    slim = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("mark")), "mix-sizes")
    cls = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0)
    slim = slim.withColumn("cls", cls)
    classes = written(slim.groupBy("source", "cls").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("words")), "mix-classes")
    sizes = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    parts = classes.select(F.col("source").alias("s"), F.col("cls").alias("c"), F.ceil(F.col("rows") / cell_rows).alias("parts"))
    t = targets.withColumnsRenamed({"source": "s"})
    parts = parts.join(t, parts["s"].eqNullSafe(t["s"])).select(parts["s"], "c", "parts", "source_size", "target")
    slim = slim.join(parts, slim["source"].eqNullSafe(parts["s"]) & (F.col("cls") == F.col("c")))
    slim = slim.withColumn("part", F.coalesce(_digest(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.col("mark").cast("string"))), 8) % F.col("parts"), F.lit(0)))
    slim = slim.drop("s", "c", "parts")
    cells = slim.groupBy("source", "cls", "part").agg(F.count(F.lit(1)).alias("rows"))
    along = Window.partitionBy("source").orderBy("cls", "part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("s"), F.col("cls").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("rows").over(along), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "cls", "part").orderBy("size", "doc_id")
    slim = slim.withColumn("nth", F.row_number().over(inside))
    slim = slim.join(cells, slim["source"].eqNullSafe(cells["s"]) & (F.col("cls") == F.col("c")) & (F.col("part") == F.col("p")))
    offset = _digest(F.concat(F.lit(seed), F.coalesce(F.concat(F.lit(":"), F.col("source")), F.lit(""))), 5) / F.lit(float(1 << 20))
    rank = (F.col("before") + F.col("nth")).cast("double")
    crossed = lambda n: F.floor(F.col("target") * n / F.col("source_size") + offset)
    copies = F.when(F.col("source_size") > 0, F.least(crossed(rank) - crossed(rank - 1), F.lit(MOST_COPIES))).otherwise(0).cast("long")
    return slim.select("doc_id", "source", "mark", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: each row of docs as often as it is taken, with docs' columns. Rows that share id, source and
    text are taken as often in all as those rows are; they share it as evenly as whole numbers can."""
    copies = systematic_copies(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    key, source, mark, n, like, nth = unused(docs, "mix_id", "mix_source", "mix_mark", "mix_copies", "mix_like", "mix_nth")
    copies = copies.groupBy(F.col("doc_id").alias(key), F.col("source").alias(source), F.col("mark").alias(mark)).agg(F.sum("copies").alias(n), F.count(F.lit(1)).alias(like))
    copies = written(copies.where(F.col(n) > 0), "mix-copies")
    same = docs[id_col].eqNullSafe(copies[key]) & docs[source_col].eqNullSafe(copies[source]) & F.xxhash64(docs[text_col]).eqNullSafe(copies[mark])
    joined = docs.join(copies.hint("shuffle_hash"), same)
    if not copies.where(F.col(like) > 1).isEmpty():
        order = Window.partitionBy(key, source, mark).orderBy(*[c for c in docs.columns if c not in (text_col, id_col, source_col)] or [F.lit(1)])
        joined = joined.withColumn(nth, F.row_number().over(order)).withColumn(n, F.floor(F.col(n) / F.col(like)) + (F.col(nth) <= F.col(n) % F.col(like)).cast("long")).where(F.col(n) > 0)
    out = joined.select(*[docs[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(key))
    return out.drop(key)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source
), k AS (
  SELECT 0 AS i, (SELECT sum(source_size) FROM s)::HUGEINT AS rest, (SELECT sum(weight) FROM s)::HUGEINT AS wsum, -1::BIGINT AS was, 0::BIGINT AS n
  UNION ALL
  SELECT k.i + 1,
    (SELECT sum(source_size) FROM s)::HUGEINT - coalesce((SELECT sum(3 * source_size) FROM s WHERE k.wsum * 3 * source_size < k.rest * weight), 0)::HUGEINT,
    (SELECT coalesce(sum(weight), 0) FROM s WHERE k.wsum * 3 * source_size >= k.rest * weight)::HUGEINT,
    k.n, (SELECT count(*) FROM s WHERE k.wsum * 3 * source_size < k.rest * weight)
  FROM k WHERE k.n <> k.was
), last AS (SELECT rest, wsum FROM k ORDER BY i DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN last.wsum * 3 * source_size < last.rest * weight THEN (3 * source_size)::DOUBLE
    ELSE (weight * last.rest)::DOUBLE / last.wsum::DOUBLE END AS target FROM s, last
), c AS (
  SELECT d.*, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END AS cls FROM d
), p AS (
  SELECT source, cls, ceil(count(*) / 4096.0)::BIGINT AS parts FROM c GROUP BY ALL
), r AS (
  SELECT c.doc_id, c.size, t.source, t.source_size, t.target,
    row_number() OVER (PARTITION BY c.source ORDER BY c.cls, ('0x' || substr(md5('mix' || c.doc_id::VARCHAR), 1, 8))::BIGINT % p.parts, c.size, c.doc_id)::DOUBLE AS n,
    ('0x' || substr(md5('mix' || coalesce(':' || c.source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u
  FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.cls = p.cls JOIN t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN least(floor(target * n / source_size + u) - floor(target * (n - 1) / source_size + u), 3) ELSE 0 END)::BIGINT * size AS taken
FROM r
"""
