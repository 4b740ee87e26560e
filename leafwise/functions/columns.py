"""Column functions: page lists, labels, texts, numbers. All are expressions, none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_PAGES = "array<int>"


def no_pages() -> Column:
    return F.array().cast(NO_PAGES)


def normalize_pages(raw: Column, n: Column) -> Column:
    """1-based page numbers to sorted distinct 0-based ones in range."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(raw, lambda p: p - 1), lambda p: (p >= 0) & (p < n))))


def normalize_reasons(raw: Column, n: Column) -> Column:
    """(page, reasons) with 1-based pages to 0-based ones in range, sorted by page, equal pages kept in their order."""
    numbered = F.transform(raw, lambda r, i: F.struct((r["page"] - 1).alias("page"), i.alias("at"), r["reasons"].alias("reasons")))
    kept = F.array_sort(F.filter(numbered, lambda r: (r["page"] >= 0) & (r["page"] < n)))
    return F.transform(kept, lambda r: F.struct(r["page"].alias("page"), r["reasons"].alias("reasons")))


def all_pages(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(no_pages())


def complement(pages: Column, n: Column) -> Column:
    """The pages of 0..n that are not listed."""
    return F.array_except(all_pages(n), pages)


def everywhere(pages: Column, n: Column) -> Column:
    return (n > 0) & (F.size(pages) >= n)


def label(reported: Column, pages: Column, n: Column) -> Column:
    """The document type that the pages tell: reported if there are none or all need OCR, text_based if none does, else mixed."""
    return F.when(n == 0, reported).when(F.size(pages) == 0, "text_based").when(F.size(pages) >= n, reported).otherwise("mixed")


def loose_type(text: Column) -> Column:
    """A document type in any spelling; unknown if it is none."""
    plain = F.lower(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    out = F.lit("unknown")
    for name in ("mixed", "image_based", "scanned", "text_based"):
        out = F.when(plain == name.replace("_", ""), name).otherwise(out)
    return out


def finite_or_zero(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x).cast("float")


def is_blank(x: Column) -> Column:
    """Whether there is nothing but white space of any kind."""
    return x.rlike(r"(?U)^\s*$")


def blank_to_null(x: Column) -> Column:
    """Null where there is nothing but white space, else the value as it is."""
    return F.when(~is_blank(x), x)


def is_pdf(content: Column, magic: bytes = b"%PDF") -> Column:
    return F.coalesce(F.startswith(content, F.lit(magic)), F.lit(False))


def base_name(path: Column) -> Column:
    """The last part of a path, the path itself if that is empty."""
    return F.coalesce(blank_to_null(F.element_at(F.split(path, "/"), -1)), path)


def resolve(folder: Column, file: Column) -> Column:
    return F.when(file.startswith("/"), file).otherwise(F.concat(folder, F.lit("/"), file))


def clip(text: Column, most: int, mark: str = "…") -> Column:
    """The first `most` characters, with a mark if there were more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)


def preview(markdown: Column, most: int = 80) -> Column:
    """The first line that isn't blank, as it stands, elided."""
    lines = F.filter(F.transform(F.split(markdown, "\n"), lambda x: F.regexp_replace(x, r"\r$", "")), lambda x: ~is_blank(x))
    return F.coalesce(clip(F.get(lines, 0), most), F.lit("(empty)"))


def format_pages(pages: Column) -> Column:
    """all for null, none for an empty list, else [a,b]."""
    return F.when(pages.isNull(), "all").when(F.size(pages) == 0, "none").otherwise(F.concat(F.lit("["), F.array_join(pages.cast("array<string>"), ","), F.lit("]")))


def shortest(x: Column) -> Column:
    """A 32-bit float as the double that prints the same."""
    return x.cast("string").cast("double")


def mojibake(text: Column) -> Column:
    """ASCII letters moved up by 0x400, as a broken font map does."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(text, letters, "".join(chr(ord(c) + 0x400) for c in letters))


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def rate_text(value: Column, why: str, digits: int = 3) -> Column:
    """A rate, or in words why there is none."""
    return F.coalesce(F.format_string(f"%.{digits}f", value), F.lit(f"n/a ({why})"))


def nearest_rank(name: str, share: float) -> Column:
    """Nearest-rank percentile of a column, an aggregate; 0 for no values."""
    return F.coalesce(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {name})"), F.lit(0.0))


def bucket(confidence: Column) -> Column:
    """Tenths 0..9 of a 32-bit confidence, widened before it is multiplied."""
    return F.least(F.greatest(F.floor(confidence.cast("double") * 10), F.lit(0)), F.lit(9)).cast("int")


def document_confidence(reported: Column, text_share: Column) -> Column:
    """The analyser's constants by document type; for text the share of text pages."""
    return F.when(reported == "scanned", 0.95).when(reported == "image_based", 0.8).when(reported == "mixed", 0.7).otherwise(text_share).cast("float")


def inspector_flag(text_ops: Column, image_pixels: Column, alnum_kinds: Column, vector_text: Column, bad_fonts: Column) -> Column:
    """The structural rule for one page: a large image with little or scan-like text, text drawn as vectors, images
    with hardly any text, or fonts that can't be read."""
    template = image_pixels >= 500_000
    return (template & (alnum_kinds < 10)) | vector_text | (template & (text_ops < 10)) | ((text_ops < 3) & (image_pixels > 0)) | bad_fonts
