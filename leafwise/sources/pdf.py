"""PDF pages without a PDF library: enough of the format to tell text pages from images, read plain text, and cut out pages.

Objects are found by scanning for `n g obj`, streams are inflated where they are Flate-coded, pages follow the page tree. Object
streams, encryption and fonts with maps of their own are not read; such pages show no text and are flagged.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAGIC = b"%PDF"
DEPTH = 64
INHERITED = ("Resources", "MediaBox", "CropBox", "Rotate")
FEATURES = "doc_id long, page_count int, error string, classify_ms double, pages array<struct<page:int,text:string,text_ops:int,image_pixels:long,alnum_kinds:int,vector_text:boolean,bad_fonts:boolean,tables:boolean,columns:boolean>>"

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R\b")
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[(?:\\.|[^\\\]])*\])\s*(Tj|TJ|'|\")|(T\*|Td|TD|Tm|ET)\b", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"(": b"(", b")": b")", b"\\": b"\\"}


class PdfError(ValueError):
    """A file that can't be read as a PDF, or pages it doesn't have."""


def is_pdf(content: bytes | None) -> bool:
    return bool(content) and bytes(content[:4]) == MAGIC


@dataclass
class Pdf:
    objects: dict[int, bytes]
    pages: list[int] = field(default_factory=list)
    parents: dict[int, int] = field(default_factory=dict)


def parse(content: bytes) -> Pdf:
    """Objects and, by the page tree, page objects in order."""
    if not is_pdf(content):
        raise PdfError("not a PDF")
    pdf = Pdf({int(m[1]): m[3] for m in _OBJECT.finditer(bytes(content))})
    root = next((n for n, b in pdf.objects.items() if re.search(rb"/Type\s*/Catalog\b", b)), None)
    if root is None or not (m := re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", pdf.objects[root])):
        raise PdfError("no page tree")
    waiting, seen = [(int(m[1]), 0, 0)], set()
    while waiting:
        number, parent, depth = waiting.pop()
        body = pdf.objects.get(number)
        if body is None or number in seen or depth > DEPTH:
            continue
        seen.add(number)
        pdf.parents[number] = parent
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            waiting += [(int(k), number, depth + 1) for k, _ in reversed(_REFERENCE.findall(kids[1]))]
        elif re.search(rb"/Type\s*/Page\b", body):
            pdf.pages.append(number)
    return pdf


def stream(body: bytes) -> bytes:
    """The data of a stream object, inflated if it is Flate-coded; empty if it can't be."""
    found = _STREAM.search(body)
    if not found:
        return b""
    if b"/FlateDecode" not in body[: found.start()]:
        return found[1]
    try:
        return zlib.decompressobj().decompress(found[1])
    except zlib.error:
        return b""


def _plain(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1")
    raw = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return raw.decode("cp1252", "replace")


def text_of(content: bytes) -> tuple[str, int]:
    """Text of a content stream and the number of its text-showing operators."""
    out, shows = [], 0
    for m in _SHOW.finditer(content):
        if m[3]:
            out.append("\n" if m[3] in (b"T*", b"Td", b"TD", b"ET") else "")
            continue
        shows += 1
        out.append("".join(_plain(s) for s in _STRING.findall(m[1])))
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n"), shows


def _reach(pdf: Pdf, number: int, name: bytes) -> bytes:
    """An entry of a page or of the nearest ancestor that has it, references followed once."""
    for _ in range(DEPTH):
        body = pdf.objects.get(number, b"")
        m = re.search(rb"/" + name + rb"\s*(<<.*?>>(?:\s*>>)*|\[.*?\]|\d+\s+\d+\s+R|\S+)", body, re.S)
        if m:
            ref = re.fullmatch(rb"(\d+)\s+\d+\s+R", m[1].strip())
            return pdf.objects.get(int(ref[1]), b"") if ref else m[1]
        number = pdf.parents.get(number, 0)
        if not number:
            break
    return b""


def page_features(pdf: Pdf, number: int) -> dict:
    """What the structural rule looks at, for one page object."""
    body = pdf.objects[number]
    contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", body, re.S)
    data = b"\n".join(stream(pdf.objects.get(int(n), b"")) for n, _ in _REFERENCE.findall(contents[1])) if contents else b""
    text, shows = text_of(data)
    resources = _reach(pdf, number, b"Resources") + body
    pixels, bad = 0, False
    for n, _ in _REFERENCE.findall(resources):
        item = pdf.objects.get(int(n), b"")
        if re.search(rb"/Subtype\s*/Image\b", item):
            size = [re.search(rb"/" + k + rb"\s+(\d+)", item) for k in (b"Width", b"Height")]
            pixels += int(size[0][1]) * int(size[1][1]) if all(size) else 0
        if re.search(rb"/Type\s*/Font\b", item):
            bad = bad or (b"/Identity-H" in item and b"/ToUnicode" not in item) or b"/Type3" in item
    paths = len(re.findall(rb"\b[clm]\b", data))
    lines = text.split("\n")
    gaps = sum(len(re.findall(r"\S {3,}\S", x)) > 0 for x in lines)
    return {
        "text": text, "text_ops": shows, "image_pixels": pixels, "alnum_kinds": len({c for c in text if c.isalnum()}), "vector_text": shows == 0 and paths > 1000, "bad_fonts": bad,
        "tables": len(re.findall(rb"\bre\b", data)) > 20, "columns": gaps > 10 and gaps * 2 > len(lines),
    }


def features(files: DataFrame) -> DataFrame:
    """FEATURES of (doc_id, content): a row per file, pages in order; what can't be parsed has an error and no pages. One file is one
    task's unit and is held in memory, as its size is bounded by the router's gate."""

    def run(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for doc_id, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                began, pages, error = time.perf_counter(), [], None
                try:
                    doc = parse(bytes(content))
                    pages = [{"page": i, **page_features(doc, n)} for i, n in enumerate(doc.pages)]
                except Exception as e:  # noqa: BLE001  a file that can't be read is a result here
                    error = f"{type(e).__name__}: {e}"[:300]
                out.append((doc_id, len(pages), error, (time.perf_counter() - began) * 1000, pages))
            yield pd.DataFrame(out, columns=["doc_id", "page_count", "error", "classify_ms", "pages"])

    return files.select("doc_id", "content").mapInPandas(run, FEATURES)


def split(content: bytes, pages: list[int]) -> bytes:
    """A PDF of some pages, in the order given. Attributes from the page tree are written into the page; annotations are dropped."""
    pdf = parse(content)
    if not pages:
        raise PdfError("no pages asked for")
    if min(pages) < 0 or max(pages) >= len(pdf.pages):
        raise PdfError(f"page {max(pages)} of {len(pdf.pages)}")
    new: dict[int, int] = {}
    bodies: list[bytes] = [b"", b""]

    def copied(number: int, depth: int) -> bytes:
        if number not in pdf.objects or depth > DEPTH:
            return b"null"
        if number not in new:
            bodies.append(b"")
            new[number] = len(bodies)
            bodies[new[number] - 1] = relinked(pdf.objects[number], depth + 1)
        return b"%d 0 R" % new[number]

    def relinked(body: bytes, depth: int) -> bytes:
        cut = _STREAM.search(body)
        head = body[: cut.start()] if cut else body
        return _REFERENCE.sub(lambda m: copied(int(m[1]), depth), head) + (body[cut.start() :] if cut else b"")

    kids = []
    for p in pages:
        number = pdf.pages[p]
        body = re.sub(rb"/Parent\s+\d+\s+\d+\s+R|/Annots\s*(\[.*?\]|\d+\s+\d+\s+R)", b"", pdf.objects[number], flags=re.S)
        for name in INHERITED:
            if not re.search(rb"/" + name.encode() + rb"\b", body) and (value := _reach(pdf, pdf.parents.get(number, 0), name.encode())):
                body = body.rstrip()[:-2] + b" /" + name.encode() + b" " + value.strip() + b" >>"
        bodies.append(b"")
        at = len(bodies)
        kids.append(b"%d 0 R" % at)
        bodies[at - 1] = relinked(body.rstrip()[:-2] + b" /Parent 2 0 R >>", 1)
    bodies[0], bodies[1] = b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    return assemble(bodies)


def assemble(bodies: list[bytes]) -> bytes:
    """A file of numbered objects, the first of which is the catalogue."""
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(bodies, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body.strip())
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, start))


def write(kinds: str, text: Callable[[int], list[str]]) -> bytes:
    """A small PDF by page kinds: s and i have an image and no text, w has both, others text only."""
    bodies: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    picture = zlib.compress(b"\x80" * 64)
    bodies.append(b"<< /Type /XObject /Subtype /Image /Width 1000 /Height 800 /ColorSpace /DeviceGray /BitsPerComponent 8 /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (len(picture), picture))
    kids = []
    for page, kind in enumerate(kinds):
        lines = [] if kind in "si" else ["stamp"] if kind == "w" else text(page)
        quoted = [x.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("cp1252", "replace") for x in lines]
        data = b"BT /F1 10 Tf 50 780 Td " + b" 0 -12 Td ".join(b"(%s) Tj" % q for q in quoted) + b" ET"
        data = (b"q 600 0 0 800 0 0 cm /I1 Do Q " if kind in "siw" else b"") + (data if quoted else b"")
        packed = zlib.compress(data)
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
        images = b" /XObject << /I1 4 0 R >>" if kind in "siw" else b""
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >>%s >> >>" % (len(bodies), images))
        kids.append(b"%d 0 R" % len(bodies))
    bodies[1] = b"<< /Type /Pages /MediaBox [0 0 600 800] /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    return assemble(bodies)


def documents(files: DataFrame, max_bytes: int) -> DataFrame:
    """Per file what evidence and the decision need. Files that aren't PDFs or are too large never reach the parser."""
    gate = F.col("content").isNotNull() & F.coalesce(F.startswith("content", F.lit(MAGIC)), F.lit(False))
    sized = files.withColumn("is_pdf", gate).withColumn("n_bytes", F.coalesce(F.octet_length("content"), F.lit(0)))
    found = features(sized.where(F.col("is_pdf") & (F.col("n_bytes") <= max_bytes)))
    return sized.drop("content").join(found, "doc_id", "left")
