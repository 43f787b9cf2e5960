"""Helpers the corpus operators share: tables in the shared folder, joins that survive hot keys, text normalisation."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows that Python gets at once; documents may be long, so a batch holds few. It is read when a plan runs, so all of this
#: package sets the same number.
BATCH_ROWS = "1000"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session runs in one process."""
    folder = spark.conf.get(SHARED, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED} to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="chronoglass-")
        spark.conf.set(SHARED, folder)
    return folder


#: Folders made by this process and not yet removed, in order.
_made: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    folder = f"{shared_dir(spark).rstrip('/')}/chronoglass/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}-{tag}"
    _made.append(folder)
    return folder


def made() -> list[str]:
    """The folders that there are."""
    return list(_made)


def remove(spark: SparkSession, folders: list[str]) -> None:
    """Deletes folders, and lets go of the shuffle files of results that nothing refers to. What was read from them must
    have been written elsewhere."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(folder)
    gc.collect()
    spark._jvm.System.gc()


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.
    The folder stays until remove() or whoever sweeps the shared folder by application."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


#: Caches that a worker keeps from task to task, as filling them is costly; only tasks of the same operator use them.
_caches: list = []


def kept_by_worker(cached):
    """cached, a function with a cache, such that tasks of other operators empty it."""
    _caches.append(cached)
    return cached


def empty_caches() -> None:
    full = [x for x in _caches if x.cache_info().currsize]
    for cached in full:
        cached.cache_clear()
    if full:
        gc.collect()  # an encoder and its stores refer to each other


def handing_back(run):
    """run, a function of batches, such that its worker hands unused memory back to the system at the end of a task:
    workers are kept for later tasks, and what one stage needed would be held through all others. What another operator
    keeps in the worker goes first."""

    def held(batches):
        empty_caches()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return held


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined to right, which has one row per key, when a key of left may hold any part of its rows.

    Keys with more than 1/share of left's rows are fewer than share, so their rows of right are broadcast whatever the
    data; all other keys meet in a shuffle in which no key has more than that part. Counts come from all rows of left,
    which should be a written table, as it is read four times. Rows with a null key meet nothing. how: inner or left.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = left.count()
    hot = counts.where(F.col("_n") * share > total).select(*keys).limit(share)
    few = left.sparkSession.createDataFrame(hot.collect(), hot.schema)
    hot_rows = left.join(F.broadcast(few), keys, "left_semi").join(F.broadcast(right.join(F.broadcast(few), keys, "left_semi")), keys, how)
    rest = left.join(F.broadcast(few), keys, "left_anti").join(right, keys, how)
    return rest.unionByName(hot_rows)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def whole(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(text: str, doc_id: str) -> Column:
    """The identifier, null-safe, and a hash of the text, as one string."""
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(whole(text).cast("string")))


def keyed_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(row_key, row): docs with all columns as one, by place, so that no name of theirs clashes with others."""
    return docs.select(row_key(text, doc_id).alias("row_key"), F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("row"))


def unkeyed_rows(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)))


def without_rows(docs: DataFrame, keys: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs without the rows whose row_key is among keys; columns as they are."""
    return unkeyed_rows(keyed_rows(docs, text, doc_id).join(keys.distinct(), "row_key", "left_anti"), docs.columns)
