"""Corpus manifests, truth sidecars, page files and environment files."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

MANIFEST = "documents ARRAY<STRUCT<file STRING, source STRING, page_count INT, needs_ocr ARRAY<INT>, note STRING>>"
TRUTH = "schema STRING, document STRING, page_count INT, needs_ocr ARRAY<INT>, pages MAP<STRING, STRUCT<needs_ocr BOOLEAN, trap STRING, kind STRING, why STRING, text STRING, text_layer STRING>>"
KEYS = {"file", "source", "page_count", "needs_ocr", "note"}
# Where an API key may stand besides a flag, first to last.
KEY_VARIABLES = ("LITELLM_API_KEY", "LITELLM_PROXY_API_KEY")


class CorpusError(ValueError):
    """A manifest that can't be used."""


def truth_error(pages: Column, n: Column) -> Column:
    """Null for a truth list without fault."""
    return F.when(F.size(F.array_distinct(pages)) < F.size(pages), "duplicate page").when(F.exists(pages, lambda p: p >= n), "page out of range")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, path, label, source, page_count, needs_ocr, note), a row per document, truth sorted. Unknown keys, an empty manifest, a duplicate page and
    one out of range are errors. Relative files are resolved against the manifest's folder."""
    raw = spark.read.text(path, wholetext=True)
    keys = raw.select(F.from_json("value", "documents ARRAY<MAP<STRING, STRING>>").alias("m"), F.json_object_keys("value").alias("top"))
    found = keys.select("top", F.array_distinct(F.flatten(F.transform("m.documents", lambda d: F.map_keys(d)))).alias("keys")).first()
    if found is None or found["top"] is None:
        raise CorpusError(f"{path} is no JSON object")
    extra = (set(found["top"]) - {"documents"}) | (set(found["keys"] or []) - KEYS)
    if extra:
        raise CorpusError(f"unknown keys in the manifest: {', '.join(sorted(extra))}")
    rows = raw.select(F.posexplode(F.from_json("value", MANIFEST)["documents"]).alias("seq", "d")).select("seq", "d.*")
    rows = rows.withColumn("needs_ocr", F.coalesce("needs_ocr", C.no_pages()))
    faults = rows.select("file", truth_error(F.col("needs_ocr"), F.col("page_count")).alias("e")).where("e IS NOT NULL").limit(1).collect()
    if faults:
        raise CorpusError(f"{faults[0]['file']}: {faults[0]['e']}")
    if rows.isEmpty():
        raise CorpusError("the manifest has no documents")
    folder = path.rpartition("/")[0]
    return rows.select("seq", "file", C.resolve(F.lit(folder), F.col("file")).alias("path"), C.base_name(F.col("file")).alias("label"), "source", "page_count", F.array_sort("needs_ocr").alias("needs_ocr"), "note")


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    """(document, page, needs_ocr, trap, kind, why): the pages of truth sidecars."""
    rows = spark.read.schema(TRUTH).option("multiLine", True).json(path)
    pages = rows.select("document", F.explode("pages").alias("page", "p"))
    return pages.select("document", F.col("page").cast("int").alias("page"), "p.needs_ocr", "p.trap", "p.kind", "p.why")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, content) of the files under a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("n_bytes"), "content")


def with_contents(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifest with content, failures): a file that isn't there is a failure row, the rest goes on."""
    plain = files.select(F.regexp_replace("path", "^file:/+", "/").alias("at"), "n_bytes", "content")
    both = manifest.join(plain, manifest["path"] == plain["at"], "left").drop("at")
    return both.where("content IS NOT NULL"), both.where("content IS NULL").select(F.col("label").alias("document"), F.lit("file can't be read").alias("error"))


def write_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Write page-<index>.md files, one folder a document, from the tasks; (doc_id, index, path) of what was written. pages: doc_id, index, markdown."""

    def run(frames):
        from pyarrow import fs

        for pdf in frames:
            paths = []
            for doc_id, index, markdown in zip(pdf["doc_id"], pdf["index"], pdf["markdown"], strict=True):
                system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
                system.create_dir(f"{base}/{doc_id}", recursive=True)
                with system.open_output_stream(f"{base}/{doc_id}/page-{index}.md") as out:
                    out.write((markdown or "").encode())
                paths.append(f"{folder}/{doc_id}/page-{index}.md")
            yield pdf[["doc_id", "index"]].assign(path=paths)

    kind = pages.schema["doc_id"].dataType.simpleString()
    return pages.select("doc_id", "index", "markdown").mapInPandas(run, f"doc_id {kind}, index int, path string")


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines: comments, `export`, quotes; the first = splits; other lines are skipped."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        key, sign, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if line.startswith("#") or not sign or not key.replace("_", "a").isalnum():
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key] = value
    return out


def unset_pairs(pairs: dict[str, str], environment: dict[str, str]) -> dict[str, str]:
    """Only what the environment doesn't have yet."""
    return {k: v for k, v in pairs.items() if k not in environment}


def load_env(path: str) -> None:
    """Set what a file says and the environment doesn't; a missing file says nothing."""
    if Path(path).is_file():
        os.environ.update(unset_pairs(parse_env(Path(path).read_text()), dict(os.environ)))


def api_key(flag: str | None, environment: dict[str, str]) -> str | None:
    """The flag, then the variables; blank ones don't count."""
    return next((x for x in [flag, *(environment.get(v) for v in KEY_VARIABLES)] if x and x.strip()), None)


def write_report(report: dict, path: str | None, as_json: bool, text: str) -> str:
    """What goes to a file or, returned, to standard output."""
    out = json.dumps(report, indent=2, default=str) if as_json else text
    if path:
        Path(path).write_text(out)
    return out
