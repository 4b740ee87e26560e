"""Results of calls that cost money are written before they are used again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the folder in spark.checkpoint.dir and read it again, so that no host is called twice for lost lineage. A local
    session without such a folder gets one; on a cluster there must be one. Tables of an application stand in a folder of its name, to be
    deleted as a whole."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share with the driver")
        folder = "file://" + tempfile.mkdtemp(prefix="leafwise-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/leafwise-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
