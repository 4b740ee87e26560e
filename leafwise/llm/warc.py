"""WARC archives, index first.

Writing: one record per page. Of records with equal payloads of a least size the one with the smallest id is a
`response` with the payload, the others are `revisit` records that refer to it. Which is which comes
from a distributed aggregate of digests; payloads are dealt out once, to the task that writes them.
Each task writes one archive (a gzip member per record) and returns its index: file, offset, length, URL, digest.

Reading: the wanted rows of the index are sorted by file and offset, neighbouring byte ranges are coalesced into one
read, and the records are cut out of what was read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, tidy, written

LEAST_REVISIT_BYTES = 0
#: Ranges with at most so many bytes between them are read at once, up to so many bytes.
GAP, READ_AT_ONCE = 64 << 10, 8 << 20
#: So many bytes of payloads are handed on at once, or one payload that is larger.
BYTES_A_BATCH = 32 << 20
INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
EMPTY_DATE = "1970-01-01T00:00:00Z"


def _filesystem(path: str):
    """The file system of a shared path and the path in it."""
    from pyarrow import fs

    if not urlsplit(path).scheme:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value has no line ends."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_id(page_id: int | None) -> str:
    return f"<urn:leafwise:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """The bytes of a record; a revisit has the payload's digest and length, not the payload."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {EMPTY_DATE}",
        *([f"WARC-Target-URI: {_clean(url)}"] if url is not None else []), f"WARC-Payload-Digest: sha1:{payload_digest}", f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: text/html", f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    length = int(headers["Content-Length"])
    if len(rest) != length + 4:
        raise ValueError("a record's length is wrong")
    return headers, rest[:length]


def _id_of(value: str | None) -> int | None:
    number = value.rpartition(":")[2].rstrip(">") if value else ""
    return int(number) if number else None


def decide(pages: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(page_id, sha, refers_to) of the revisits, each once. Digests only are dealt out; a digest's smallest id is found by an
    aggregate that combines before it shuffles, and joined back."""
    slim = written(pages.where((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "sha").distinct(), "warc-digests")
    first = slim.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return slim.join(first, "sha").where("page_id <> refers_to").select("page_id", "sha", "refers_to")


def write(pages: DataFrame, to: str | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """Write the archives into a folder and return their index, one row per page.

    Payload: the html in UTF-8, empty where it is null. A null URL gives a record without target. Rows that repeat an
    id are written each, and each payload of an id is a revisit or not on its own; rows that repeat the first id of a payload
    are responses, as are rows without an id, which are never referred to. A task that runs again writes a file of its own
    name; the index names the files of the tasks that counted.
    """
    import pyarrow as pa

    spark = pages.sparkSession
    folder = to or fresh(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    named = rows.where("page_id IS NOT NULL").withColumn("sha", F.sha1("payload"))
    revisits = written(decide(named, least), "warc-revisits")
    # Rows without an id stay where they are: no key deals them out.
    rows = named.join(revisits.hint("shuffle_hash"), ["page_id", "sha"], "left").drop("sha").unionByName(rows.where("page_id IS NULL").withColumn("refers_to", F.lit(None).cast("long")))

    def run(batches) -> Iterator[pa.RecordBatch]:
        import uuid

        filesystem, base = _filesystem(folder)
        filesystem.create_dir(base, recursive=True)
        name, out, offset = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                index = []
                for page_id, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                    out = out or filesystem.open_output_stream(_filesystem(name)[1], compression=None)
                    found = digest(payload)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, found, refers)) + packer.flush()
                    out.write(raw)
                    index.append((page_id, name, offset, len(raw), url, found, len(payload), "response" if refers is None else "revisit", refers))
                    offset += len(raw)
                if index:
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out:
                out.close()

    return written(rows.mapInArrow(tidy(run), INDEX), "warc-index")


def fetch(index: DataFrame) -> DataFrame:
    """Read the records of an index: page_id, url, payload (null for revisits), payload_bytes, payload_digest,
    record_type, refers_to, all from the archives. Ranges are dealt out by file, sorted by offset, and read coalesced."""
    import pyarrow as pa

    slices = index.select("file", "offset", "length", F.floor(F.col("offset") / (16 << 20)).alias("slice_"))
    dealt = slices.repartition("file", "slice_").sortWithinPartitions("file", "offset").drop("slice_")
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches) -> Iterator[pa.RecordBatch]:
        handles: dict = {}

        def records(ranges: list[tuple[str, int, int]]):
            name, start = ranges[0][:2]
            if name not in handles:
                for h in handles.values():
                    h.close()
                handles.clear()
                filesystem, path = _filesystem(name)
                handles[name] = filesystem.open_input_file(path)
            data = handles[name].read_at(ranges[-1][1] + ranges[-1][2] - start, start)
            for _, at, length in ranges:
                yield parse(zlib.decompress(data[at - start : at - start + length], 31))

        def batch_of(found):
            rows = [(_id_of(h["WARC-Record-ID"]), h.get("WARC-Target-URI"), None if h["WARC-Type"] == "revisit" else body, int(h["X-Payload-Length"]) if h["WARC-Type"] == "revisit" else len(body),
                     h["WARC-Payload-Digest"].partition(":")[2] if h["WARC-Type"] == "revisit" else digest(body), h["WARC-Type"], _id_of(h.get("WARC-Refers-To"))) for h, body in found]
            kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        def out(found):
            """Batches of bounded size, whatever the payloads were packed to."""
            held, size = [], 0
            for headers, body in found:
                held.append((headers, body))
                size += len(body)
                if size >= BYTES_A_BATCH:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

        run_: list[tuple[str, int, int]] = []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if run_ and (name != run_[-1][0] or offset - run_[-1][1] - run_[-1][2] > GAP or offset < run_[-1][1] or offset + length - run_[0][1] > READ_AT_ONCE):
                    yield from out(records(run_))
                    run_ = []
                run_.append((name, offset, length))
        if run_:
            yield from out(records(run_))
        for h in handles.values():
            h.close()

    return dealt.mapInArrow(tidy(run), schema)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS sha FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(sha, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31))::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""
