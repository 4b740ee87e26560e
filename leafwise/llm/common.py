"""What several operators share: reading tables, cutting lineage, the held-out fold."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts, as a Java and a Python pattern alike.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let the Python workers of a running session find this package where the driver has it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one (as in tests) gets its own; on a cluster there must be one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        found = "file://" + tempfile.mkdtemp(prefix="leafwise-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """The folder of all tables that this application writes; discard() deletes it."""
    return f"{shared_dir(spark)}/leafwise-{spark.sparkContext.applicationId}"


def fresh(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors, is computed once."""
    path = fresh(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables that written() gave, when all that was made of them has been written as well."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)


def discard(spark: SparkSession) -> None:
    """Delete every table of this application, once its results have been read or stored."""
    _delete(spark, own_dir(spark))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 4 is 2; a null doc_id is not held out."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def share_of_ids(doc_id: Column | str, share: Column | float) -> Column:
    """Whether the hash of an id falls under a share of all hashes: a sample that needs no sort and is the same each time."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.xxhash64(col), F.lit(1 << 30)) < (F.lit(share) if isinstance(share, float) else share) * (1 << 30)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none clashes with a column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tidy(run):
    """A function of batches whose task gives its memory back at its end: Python workers live on, and what they hold
    besides the JVM counts as the executor's."""

    def through(batches):
        try:
            yield from run(batches)
        finally:
            import pyarrow

            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return through


def map_texts(docs: DataFrame, text_col: str, fields: str, make, keep: list[str] | None = None) -> DataFrame:
    """Append columns that a Python function of the texts gives, in Arrow batches.

    make() is called in the task and returns a function from a list of texts (null as empty) to a list of Arrow arrays, one a
    field of `fields` (DDL). keep: the columns that stay, all by default. Fields should not clash with them, see unused().
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    stay = list(docs.columns) if keep is None else list(keep)
    sent = docs.select(*[F.col(f"`{c}`") for c in stay], *([] if text_col in stay else [F.col(f"`{text_col}`")]))
    added = T.StructType.fromDDL(fields)
    at = sent.columns.index(text_col)

    def run(batches):
        from .bpe import parts_of

        work = make()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in parts_of(texts, 1_000_000):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(stay)], *work(texts[a:b])], names=[*stay, *added.names])

    return sent.mapInArrow(tidy(run), T.StructType([*sent.schema.fields[: len(stay)], *added.fields]))
