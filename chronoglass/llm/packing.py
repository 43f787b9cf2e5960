"""Packing: concatenate and cut by global offsets from prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches
from .tokens import END, STORE, encoder

WINDOW = 4096


def _encode(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at, end = encoder(path, size), TaskContext.get().partitionId(), 0, np.array([END], "<u4").tobytes()
        for b in batches:
            ids = [x + end for x in enc.encode(b.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part)), pa.array(ends - n), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "part", "local", "n", "ids"])
            at = int(ends[-1]) if len(n) else at

    return run


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", doc_id: str = "doc_id", store: int = STORE) -> DataFrame:
    """A written table (doc_id, part, local, n, ids): local is the place of a document in its partition's tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return materialise(rows.mapInArrow(_encode(tokenizer, store), "doc_id long, part long, local long, n long, ids binary"), "tokens")


def bases(tokens: DataFrame) -> DataFrame:
    """(part, base): the exclusive prefix sum of the partitions' totals, a row per partition that has documents."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    rows, at = [], 0
    for r in totals:
        rows.append((r["part"], at))
        at += r["n"]
    return tokens.sparkSession.createDataFrame(rows, "part long, base long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", store: int = STORE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (32-bit little-endian), doc_tokens, sequence_id, offset.

    The first pass writes each document's ids with its place among its partition's tokens; the partitions' totals, a
    number each, are prefix-summed; base and place give global offsets, and windows of `window` tokens cut there. A piece
    that a boundary ends and the one after it are the boundary records: they share doc_id and differ in start and
    sequence_id. Only the last sequence can be short, so padding is under one window for the whole corpus. Null texts are
    empty, and any document has its end id at least; null identifiers stay null; repeated rows are packed each. An empty
    table gives no piece. store: units of text that a worker's encoder keeps.
    """
    tokens = encoded(docs, tokenizer, text, doc_id, store)
    rows = tokens.join(F.broadcast(bases(tokens)), "part").withColumn("at", F.col("base") + F.col("local"))
    first, last = F.floor(F.col("at") / F.lit(window)), F.floor((F.col("at") + F.col("n") - 1) / F.lit(window))
    rows = rows.select("doc_id", "n", "ids", "at", F.explode(F.sequence(first, last)).alias("sequence_id"))
    start = F.greatest(F.col("at"), F.col("sequence_id") * window) - F.col("at")
    stop = F.least(F.col("at") + F.col("n"), (F.col("sequence_id") + 1) * window) - F.col("at")
    rows = rows.select("doc_id", "n", "ids", "at", "sequence_id", start.alias("start"), (stop - start).alias("length"))
    return rows.select(
        "doc_id", "start", "length", F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
        F.col("n").alias("doc_tokens"), "sequence_id", (F.col("at") + F.col("start") - F.col("sequence_id") * window).alias("offset"),
    )
