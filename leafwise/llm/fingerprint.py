"""Document fingerprints as Merkle trees.

A text's lines are its paragraphs; a paragraph is cut into pieces of 32 characters, the leaves. A paragraph's digest is over those
of its pieces, a section's over those of 8 paragraphs, the root's over those of the sections; all are whole digests, and only
what is printed is shortened. A fingerprint is the root, the section digests and the leaf digests as one string: equal roots
say equal texts; where roots differ, differing sections and leaves say where. Likeness is the Dice measure of the
two sets of leaves.

Next documents are found without a global window: ids are cut into ranges of a few thousand at quantiles, the first document
of a range is also sent to the range before it, and each range is a window of its own. A text is dealt out once and digested once;
of an edited text only what follows the last whole paragraph that it kept is digested anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE, PARAGRAPHS, DIGITS = 32, 8, 8
#: Documents of a range, and how many ranges at most are cut; beyond, ranges grow (they are sorted with spilling).
ROWS_A_RANGE, RANGES = 2_000, 65_536
LOWEST = -(1 << 63)
EMPTY = "array<array<string>>"


def _digest(value: Column) -> Column:
    return F.md5(value.cast("binary"))


def pieces(text: Column) -> Column:
    """The leaf digests by paragraph: array of array of string. Nothing for an empty text."""
    cut = lambda p: F.transform(F.regexp_extract_all(p, F.lit(rf"[\s\S]{{1,{PIECE}}}"), 0), _digest)
    return F.when(text == "", F.array().cast(EMPTY)).otherwise(F.transform(F.split(text, "\n", -1), cut))


def sections(paragraphs: Column) -> Column:
    """Section digests over paragraph digests, from the leaf digests by paragraph."""
    whole = F.transform(paragraphs, lambda leaves: _digest(F.array_join(leaves, "")))
    starts = F.when(F.size(paragraphs) > 0, F.sequence(F.lit(1), F.size(paragraphs), F.lit(PARAGRAPHS))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: _digest(F.array_join(F.slice(whole, i, F.lit(PARAGRAPHS)), "")))


def short(digests: Column) -> Column:
    return F.transform(digests, lambda d: F.substring(d, 1, DIGITS))


def fingerprint(paragraphs: Column, branches: Column, leaves: Column) -> Column:
    """root:sections:leaves, of leaf digests by paragraph, section digests and shortened leaves."""
    root = _digest(F.concat(F.size(paragraphs).cast("string"), F.lit(":"), F.array_join(branches, "")))
    return F.concat_ws(":", root, F.array_join(short(branches), ","), F.array_join(leaves, ","))


def likeness(a: Column, b: Column) -> Column:
    """Dice measure of two sets of leaves; 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * both / total)


def differing_sections(a: Column, b: Column) -> Column:
    """Numbers, from 0, of the sections whose digests differ, of two lists of them."""
    return F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, i: F.when(x["a"].eqNullSafe(x["b"]), -1).otherwise(i)), lambda i: i >= 0)


def with_next(docs: DataFrame, key: Column, *columns: str, derive=lambda dealt: dealt, derived: tuple[str, ...] = ()) -> DataFrame:
    """docs with next_<column> of the row that follows by key, after the last the first, also of the columns `derived` that the
    function derive adds. Rows of one key follow by the columns. The key is an integer, null the least. At most RANGES quantiles of the key come to the driver."""
    keyed = docs.withColumn("key_", F.coalesce(key.cast("long"), F.lit(LOWEST)))
    n, low = keyed.agg(F.count(F.lit(1)), F.min("key_")).first()
    parts = max(1, min(RANGES, -(-n // ROWS_A_RANGE)))
    cuts = keyed.agg(F.percentile_approx("key_", [i / parts for i in range(1, parts)] or [0.5], max(10_000, 20 * parts))).first()[0] or []
    heads = sorted({low if low is not None else LOWEST, *(cuts if parts > 1 else [])})
    fan = max(1, math.isqrt(len(heads)))
    groups = [heads[i : i + fan] for i in range(0, len(heads), fan)]
    first = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    inner = F.array(*[F.array(*[F.lit(x).cast("long") for x in g]) for g in groups])
    k = F.col("key_")
    group = F.size(F.filter(first, lambda x: x <= k))
    keyed = keyed.withColumn("group_", group)
    keyed = keyed.withColumn("range_", (F.col("group_") - 1) * fan + F.size(F.filter(F.element_at(inner, F.col("group_")), lambda x: x <= k)) - 1)
    is_head = F.element_at(F.element_at(inner, F.col("group_")), F.col("range_") % fan + 1) == k
    own = F.struct(F.col("range_").alias("at"), F.lit(0).alias("ghost"))
    before = F.struct(F.pmod(F.col("range_") - 1, F.lit(len(heads))).alias("at"), F.lit(1).alias("ghost"))
    dealt = keyed.withColumn("to_", F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.withColumn("at_", F.col("to_.at")).withColumn("ghost_", F.col("to_.ghost")).drop("to_", "group_", "range_")
    # What is derived from a text is made after it is dealt out, and its successor's copy comes from the window.
    dealt = derive(dealt.repartition("at_"))
    w = Window.partitionBy("at_").orderBy("ghost_", "key_", *columns)
    columns = [c for c in dealt.columns if c in (*columns, *derived)]
    for c in columns:
        dealt = dealt.withColumn(f"next_{c}", F.lead(c).over(w))
    return dealt.where("ghost_ = 0").drop("at_", "ghost_", "key_")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edited_sections (numbers from 0 of the
    sections in which the edited text differs, as text).

    A null text is read as an empty one; two empty texts are alike by 1. The edited text has its last quarter
    replaced by the start of the next document, by ascending id; a lone document is its own next. Rows that repeat an id
    follow each other by text.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = lambda dealt: dealt.withColumn("own", pieces(F.col("text"))).withColumn("own_leaves", short(F.flatten("own"))).withColumn("own_set", F.array_distinct("own_leaves"))
    rows = with_next(rows, F.col("doc_id"), "text", derive=own, derived=("own_set",))
    n = F.length("text").cast("int")
    rows = rows.withColumn("n_chars", n).withColumn("quarter", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("prefix", F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.col("quarter"))).withColumn("added", F.substring(F.col("next_text"), F.lit(1), F.col("quarter")))
    # Paragraphs that end in the prefix stand as they were.
    rows = rows.withColumn("stay", F.size(F.split("prefix", "\n", -1)) - 1).withColumn("open", F.concat(F.substring_index("prefix", "\n", -1), "added"))
    edited = F.concat("prefix", "added")
    changed = F.when(edited == "", F.array().cast(EMPTY)).otherwise(F.concat(F.slice("own", F.lit(1), F.col("stay")), F.when(F.col("open") == "", F.array(F.array().cast("array<string>"))).otherwise(pieces(F.col("open")))))
    rows = rows.select("doc_id", "n_chars", F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), "own", "own_leaves", "own_set", "next_own_set", changed.alias("changed"))
    rows = rows.withColumn("own_sections", sections(F.col("own"))).withColumn("changed_sections", sections(F.col("changed"))).withColumn("changed_leaves", short(F.flatten("changed")))
    rows = rows.withColumn("changed_set", F.array_distinct("changed_leaves"))
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", fingerprint(F.col("own"), F.col("own_sections"), F.col("own_leaves")).alias("fingerprint"),
        fingerprint(F.col("changed"), F.col("changed_sections"), F.col("changed_leaves")).alias("edited_fingerprint"), likeness(F.col("own_set"), F.col("changed_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_own_set")).alias("near_next"),
        F.array_join(differing_sections(F.col("own_sections"), F.col("changed_sections")).cast("array<string>"), ",").alias("edited_sections"))


def _oracle() -> str:
    cut = lambda c: f"CASE WHEN {c} = '' THEN []::VARCHAR[][] ELSE list_transform(string_split({c}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s).{{1,{PIECE}}}'), lambda x: md5(x))) END"
    branch = lambda c: f"list_transform(range(0, len({c}), {PARAGRAPHS}), lambda i: md5(array_to_string(list_slice(list_transform({c}, lambda l: md5(array_to_string(l, ''))), i + 1, i + {PARAGRAPHS}), '')))"
    mark = lambda c, s: f"concat_ws(':', md5(concat(len({c}), ':', array_to_string({s}, ''))), array_to_string(list_transform({s}, lambda b: substr(b, 1, {DIGITS})), ','), array_to_string(list_transform(flatten({c}), lambda x: substr(x, 1, {DIGITS})), ','))"
    leaves = lambda c: f"list_distinct(list_transform(flatten({c}), lambda x: substr(x, 1, {DIGITS}))) AS {c}_l"
    dice = lambda a, b: f"CASE WHEN len({a}_l) + len({b}_l) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}_l, {b}_l)) / (len({a}_l) + len({b}_l)) END"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id, text), first_value(text) OVER (ORDER BY doc_id, text)) AS next, length(text) AS n_chars FROM d),
e AS (SELECT *, left(text, (n_chars - n_chars // 4)::INT) || left(next, (n_chars // 4)::INT) AS edited FROM n),
p AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {cut('text')} AS own, {cut('edited')} AS changed, {cut('next')} AS other FROM e),
s AS (SELECT *, {branch('own')} AS own_s, {branch('changed')} AS changed_s, {leaves('own')}, {leaves('changed')}, {leaves('other')} FROM p)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256, {mark('own', 'own_s')} AS fingerprint, {mark('changed', 'changed_s')} AS edited_fingerprint,
  {dice('own', 'changed')} AS near_edited, {dice('own', 'other')} AS near_next,
  array_to_string(list_filter(range(0, greatest(len(own_s), len(changed_s))), lambda i: own_s[i + 1] IS DISTINCT FROM changed_s[i + 1]), ',') AS edited_sections FROM s
"""


ORACLE = _oracle()
