"""Token-ID output: flat unsigned integer files, 64-bit document offsets, bases from prefix sums."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_folder, small_batches
from .tokens import END, encoder

WIDTHS = {1: "u1", 2: "<u2", 4: "<u4"}
#: Units that a worker's encoder keeps; this operator holds little else.
STORE = 450_000


def _open(folder: str):
    """The folder's file system and the path in it; any store that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder)


def _writer(folder: str, tokenizer: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        task, enc, end = TaskContext.get(), encoder(tokenizer, STORE), np.array([END], "<u4")
        name = f"shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        data, docs, total = None, 0, 0
        for b in batches:
            if data is None:
                store.create_dir(root, recursive=True)
                data, offsets, ids_file = store.open_output_stream(f"{root}/{name}.bin"), store.open_output_stream(f"{root}/{name}.idx"), store.open_output_stream(f"{root}/{name}.doc")
            ids = b.column(0).to_pylist()
            for ids_of in enc.encode(b.column(1).to_pylist()):
                out = np.concatenate([np.frombuffer(ids_of, "<u4"), end]).astype(WIDTHS[width])
                offsets.write(np.array([total], "<u8").tobytes())
                data.write(out.tobytes())
                total += len(out)
            ids_file.write(np.array([[i is not None, i or 0] for i in ids], "<i8").tobytes())
            docs += len(ids)
        if data is not None:
            offsets.write(np.array([total], "<u8").tobytes())
            for f in (data, offsets, ids_file):
                f.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "name": [name], "docs": [docs], "tokens": [total]}, schema=pa.schema([("shard", pa.int64()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, width: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Writes docs to folder in ascending doc_id order; returns (shard, name, base, docs, tokens), a row per shard.

    Documents are range-partitioned and sorted by identifier; a shard is NAME.bin, the ids as unsigned integers of
    `width` bytes, each document's followed by the end id; NAME.idx, documents + 1 unsigned 64-bit offsets in tokens;
    NAME.doc, a pair (known, doc_id) of 64-bit integers per document. Each attempt of a task writes files of its own, and
    the table names those that count, so that retried and lost tasks leave nothing half-written in it. manifest.json
    lists them with their bases, the prefix sums of the shards' tokens. Null texts are empty; null identifiers come first.
    Rows of one identifier come in any order, and may be spread over several shards. A vocabulary that `width` bytes
    can't number is refused.
    """
    size = encoder(tokenizer, STORE).tok.get_vocab_size()
    if size > 1 << 8 * width:
        raise ValueError(f"{width} bytes can't hold the ids of {size} tokens")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    shards = materialise(rows.mapInArrow(_writer(folder, tokenizer, width), "shard long, name string, docs long, tokens long"), "shards")
    listed, at = [], 0
    for r in shards.orderBy("shard").collect():
        listed.append((r["shard"], r["name"], at, r["docs"], r["tokens"]))
        at += r["tokens"]
    out = docs.sparkSession.createDataFrame(listed, "shard long, name string, base long, docs long, tokens long")
    store, root = _open(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"width": width, "tokens": at, "shards": [dict(zip(("shard", "name", "base", "docs", "tokens"), x, strict=True)) for x in listed]}).encode())
    return out


def _mapped(store, path: str, kind: str) -> np.ndarray:
    """The file as an array: memory-mapped where the store is a local one, else read."""
    if store.type_name == "local":
        with pa.memory_map(path) as f:
            return np.frombuffer(f.read_buffer(), kind)
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), kind)


def _reader(folder: str, width: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(folder)
        for b in batches:
            for r in b.to_pylist():
                ids, offsets, names = (_mapped(store, f"{root}/{r['name']}.{x}", k) for x, k in (("bin", WIDTHS[width]), ("idx", "<u8"), ("doc", "<i8")))
                names, offsets = names.reshape(-1, 2), offsets.astype(np.int64)
                for i in range(0, len(names), 2000):
                    o = offsets[i : i + 2001]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(o[:-1].tolist(), o[1:].tolist(), strict=True)] if digest else [0] * (len(o) - 1)
                    part = names[i : i + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[:, 1], mask=part[:, 0] == 0), pa.array(r["base"] + o[:-1]), pa.array(np.diff(o)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                    )

    return run


def read_tokens(spark: SparkSession, folder: str, shards: DataFrame, width: int = 4) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32 bits)."""
    n = max(1, shards.count())
    return shards.repartition(n, "shard").mapInArrow(_reader(folder, width, True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, width: int = 4) -> DataFrame:
    """Writes docs to a new folder in the shared one and reads the files back."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    return read_tokens(spark, folder, write_tokens(docs, folder, tokenizer, width), width)
