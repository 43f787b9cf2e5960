"""Tables that operators write on their way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SHARED = "spark.checkpoint.dir"


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder. A temporary folder serves only where the session runs in one process."""
    folder = spark.conf.get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronoglass-")
        spark.conf.set(SHARED, folder)
    return f"{folder.rstrip('/')}/chronoglass/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """df, written and read again: lineage ends there, and a lost executor costs no recomputation."""
    path = place(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
