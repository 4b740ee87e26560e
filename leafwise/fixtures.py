"""Test corpora as data: page kinds, document recipes, seeded text and its damage."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C

# What each page kind is. (needs OCR in truth, flagged by the analyser's rule)
KINDS = {
    "t": (False, False), "c": (False, False), "i": (True, True), "n": (False, False), "s": (True, True),
    "b": (True, False), "u": (True, False), "h": (True, False), "m": (True, False), "w": (False, True),
}
# The documents of the corpus, a character a page, and their source.
DOCUMENTS = {
    "empty": ("", "synthetic"), "single_text": ("t", "synthetic"), "single_image": ("i", "synthetic"), "text": ("tt", "synthetic"), "scanned": ("ii", "synthetic"),
    "mixed": ("titi", "synthetic"), "text_dense": ("t" * 10 + "c", "synthetic"), "mixed_long": ("tti" * 8, "synthetic"), "mixed_long_split": ("itt" * 8, "synthetic"), "scanned_long": ("i" * 30, "synthetic"),
    "preocr_scan": ("bububu", "adversarial"), "watermarked_memo": ("wwwww", "adversarial"), "broken_tounicode_report": ("mmmmm", "adversarial"), "sparse_chrome_scan": ("hhhhh", "adversarial"),
    "honest_mixed": ("nsnsns", "adversarial"), "stamped_invoices": ("wnwn", "adversarial"), "tounicode_mixed": ("nmnms", "adversarial"), "rescan_batch": ("buhsuhsb", "adversarial"), "mixed_adversarial": ("nbnwshmnuwsn", "adversarial"),
}
# The document types the analyser reports where all pages are flagged or there are none.
REPORTED = {"watermarked_memo": "image_based"}
# End of fixed values.
WORDS = "invoice total report page under each customer order amount due date review policy system record value state account note table".split()
CONFUSIONS = {"l": "1", "o": "0", "e": "c", "m": "rn", "i": "l", "s": "5", "a": "o", "t": "f"}


def recipes(spark: SparkSession) -> DataFrame:
    """(seq, document, kinds, source, reported)"""
    rows = [(i, name, kinds, source, REPORTED.get(name, "scanned")) for i, (name, (kinds, source)) in enumerate(DOCUMENTS.items())]
    return spark.createDataFrame(rows, "seq int, document string, kinds string, source string, reported string")


def build(documents: DataFrame) -> DataFrame:
    """(document, source, page, kind, needs_ocr, flagged): a row per page of recipes."""
    kind = F.when(F.length("kinds") > 0, F.split("kinds", "")).otherwise(F.array().cast("array<string>"))
    rows = documents.select("document", "source", F.posexplode(F.filter(kind, lambda k: k != "")).alias("page", "kind"))
    yes = lambda i: F.col("kind").isin(*[k for k, v in KINDS.items() if v[i]])
    return rows.withColumn("needs_ocr", yes(0)).withColumn("flagged", yes(1))


def documents(spark: SparkSession) -> DataFrame:
    """The corpus with its pages as arrays: seq, document, source, page_count, flagged, truth, reported."""
    r = recipes(spark)
    pages = build(r).groupBy("document").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("page")))).alias("f"), F.array_sort(F.collect_list(F.when(F.col("needs_ocr"), F.col("page")))).alias("t"))
    j = r.join(pages, "document", "left")
    return j.select("seq", "document", "source", F.coalesce("n", F.lit(0)).alias("page_count"), F.coalesce("f", C.no_pages()).alias("flagged"), F.coalesce("t", C.no_pages()).alias("truth"), "reported")


def wrap(words: list[str], width: int) -> list[str]:
    """Words in lines of at most so many characters; a longer word has a line of its own."""
    lines: list[str] = []
    for w in words:
        if lines and len(lines[-1]) + 1 + len(w) <= width:
            lines[-1] += f" {w}"
        else:
            lines.append(w)
    return lines


def body_lines(title: str, page: int, count: int, width: int = 72) -> list[str]:
    """So many lines of seeded prose."""
    draw = random.Random(f"{title}/{page}")
    lines: list[str] = []
    while len(lines) < count:
        words = [draw.choice(WORDS) for _ in range(draw.randint(6, 14))]
        lines += wrap([words[0].capitalize(), *words[1:-1], words[-1] + "."], width)
    return lines[:count]


def garble(lines: list[str], seed: str, lost: float = 0.14) -> list[str]:
    """What bad OCR makes of lines: some dropped, characters confused, words fused."""
    draw = random.Random(seed)
    out = []
    for line in lines:
        if draw.random() < lost:
            continue
        text = "".join(CONFUSIONS[c] if c in CONFUSIONS and draw.random() < 0.25 else c for c in line)
        out.append("".join("" if c == " " and draw.random() < 0.2 else c for c in text))
    return out


def write_state(new: Column, old: Column, force: Column) -> Column:
    """unchanged for equal contents; wrote for a new file or if forced; else kept. By SHA-256."""
    same = F.sha2(new, 256).eqNullSafe(F.sha2(old, 256))
    return F.when(same, "unchanged").when(old.isNull() | force, "wrote").otherwise("kept")
