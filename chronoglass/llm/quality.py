"""Quality rules: counts of a text by itself, then lines that too many documents of its host share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import materialise, row_key, small_batches, spread_join

#: A text with fewer words fails, and so does one of whose words more than so many in a hundred stand in repeated windows.
MIN_WORDS, MAX_REPEATED, WINDOW = 10, 20, 5
#: A line is removed at a host if more than LINE_DOCS documents and more than LINE_PERCENT in a hundred of the host's hold it.
LINE_DOCS, LINE_PERCENT = 10, 1
#: A document is depleted if fewer than so many of a hundred words are left.
LEFT_PERCENT = 30
SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_NORMAL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LINES = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("words", pa.int64())]))


def line_key(line: bytes) -> bytes:
    """The line's words with one blank between, A-Z in lower case and each digit a 0."""
    return b" ".join(line.translate(_NORMAL).split())


def _hash(data: bytes) -> tuple[int, int]:
    """128 bits as two signed integers."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), ">i8").tolist())


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words that the text has at least twice."""
    n = len(words)
    if n <= window:
        return 0
    known: dict[bytes, int] = {}
    single = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    grams = single
    for k in range(1, window):  # numbers for the windows of one word more, the same for the same words
        grams = np.unique(grams[:-1] * len(known) + single[k:], return_inverse=True)[1]
    often = np.bincount(grams)[grams] > 1
    edges = np.zeros(n + 1, np.int64)
    edges[: len(often)] += often
    edges[window:] -= often
    return int((np.cumsum(edges[:-1]) > 0).sum())


def counts_of(raw: bytes, chars: int) -> tuple[int, ...]:
    """COUNTS of a text of so many code points."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.split()] if b"\n" in raw else []
    return len(words), chars - len(raw) + len(raw.translate(None, SPACE)), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def lines_of(raw: bytes) -> list[tuple[int, int, int]]:
    """(h1, h2, words) for each different line key of a text, with the words of all its lines."""
    found: dict[bytes, int] = {}
    for line in raw.split(b"\n"):
        key = line_key(line)
        if key:
            found[key] = found.get(key, 0) + key.count(b" ") + 1
    return [(*_hash(key), n) for key, n in found.items()]


def _measure(kinds: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            raws = [t.encode() for t in texts]
            counts = np.array([counts_of(r, len(t)) for r, t in zip(raws, texts, strict=True)], np.int64).reshape(-1, len(COUNTS))
            lines = [lines_of(r) for r in raws]
            flat = np.array([x for found in lines for x in found], np.int64).reshape(-1, 3)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in lines])]).astype(np.int32)
            held = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(LINES.value_type)))
            texts = np.array([_hash(r) for r in raws], np.int64).reshape(-1, 2)
            made = {"t1": pa.array(texts[:, 0]), "t2": pa.array(texts[:, 1]), "lines": held} | {c: pa.array(counts[:, k]) for k, c in enumerate(COUNTS)}
            yield pa.RecordBatch.from_arrays([made[f.name] if f.name in made else b.column(f.name).cast(f.type) for f in kinds], schema=kinds)

    return run


def measured(docs: DataFrame, text: str, host: str, carry: dict[str, Column]) -> DataFrame:
    """A written table without texts: rid, host, the carried columns, t1 and t2 (a hash of the text), COUNTS, lines."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    # no host is one, before and apart from the empty name
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("host"), *(c.alias(n) for n, c in carry.items()), F.col(text).cast("string").alias("text"))
    kept = rows.drop("text").schema
    kinds = pa.schema([*to_arrow_schema(kept), ("t1", pa.int64()), ("t2", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("lines", LINES)])
    said = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", t1 long, t2 long, " + ", ".join(f"{c} long" for c in COUNTS) + ", lines array<struct<h1: long, h2: long, words: long>>"
    return materialise(rows.mapInArrow(_measure(kinds), said), "measured")


def frequent_lines(found: DataFrame, line_docs: int = LINE_DOCS, line_percent: int = LINE_PERCENT) -> DataFrame:
    """(host, h1, h2, n_docs) of the lines above the limits, written. Documents of one text count once at a host, so that
    copies of a page don't make its lines common."""
    held = found.select("host", "t1", "t2", F.explode("lines").alias("line")).select("host", "t1", "t2", "line.h1", "line.h2")
    common = held.groupBy("host", "h1", "h2").agg(F.count_distinct("t1", "t2").alias("n_docs")).where(F.col("n_docs") > line_docs)
    hosts = found.groupBy("host").agg(F.count_distinct("t1", "t2").alias("host_docs"))
    return materialise(common.join(hosts, "host").where(F.col("n_docs") * 100 > F.col("host_docs") * line_percent).select("host", "h1", "h2", "n_docs"), "frequent")


def _judged(found: DataFrame, left_percent: int, min_words: int, max_repeated: int, **limits) -> tuple[DataFrame, DataFrame]:
    """found with base_failed, n_lost_words and kept, without lines; and (rid, h1, h2) of the lines that rows lose."""
    lines = found.select("rid", "host", F.explode("lines").alias("line")).select("rid", "host", "line.*")
    lost = spread_join(lines, frequent_lines(found, **limits).drop("n_docs"), ["host", "h1", "h2"]).select("rid", "h1", "h2", "words")
    out = found.drop("lines").join(lost.groupBy("rid").agg(F.sum("words").alias("lost")), "rid", "left")
    out = out.withColumn("n_lost_words", F.coalesce("lost", F.lit(0))).drop("lost")
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated))
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("n_lost_words")) * 100 >= F.col("n_words") * left_percent)), lost


def judge(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", left_percent: int = LEFT_PERCENT, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, **limits) -> DataFrame:
    """One row per row: doc_id, COUNTS, base_failed, n_lost_words, kept.

    A line's key is its words with single blanks, A-Z lower-cased and digits as 0, hashed to 128 bits. A host's documents
    are counted by their different texts; keys that more than line_docs of them, and more than line_percent in a hundred,
    hold are removed there. A document is kept if its own counts don't fail it and left_percent in a hundred of its words
    are left. A null text has no word and fails. A null host is a host of its own; repeated rows are judged each, and
    count as one document; identifiers don't matter. An empty table gives no row.
    """
    found = measured(docs, text, host, {"doc_id": F.col(doc_id)})
    return _judged(found, left_percent, min_words, max_repeated, **limits)[0].select("doc_id", *COUNTS, "base_failed", "n_lost_words", "kept")


@F.pandas_udf(StringType())
def _without(texts: pd.Series, lost: pd.Series) -> pd.Series:
    def left(text: str, gone) -> str:
        gone = {(x["h1"], x["h2"]) for x in gone} if gone is not None else ()
        return "\n".join(x for x in text.split("\n") if not gone or _hash(line_key(x.encode())) not in gone)

    return pd.Series([left(t, g) if t is not None else None for t, g in zip(texts, lost, strict=True)], dtype=object)


def cleaned(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", host: str = "source", left_percent: int = LEFT_PERCENT, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, **limits) -> DataFrame:
    """The kept rows of docs, all columns as they are but for the text, which goes without the lines above the limits."""
    key = F.struct(row_key(text, doc_id).alias("row"), F.col(host).cast("string").alias("host"))
    found, lost = _judged(measured(docs, text, host, {"row": F.to_json(key)}), left_percent, min_words, max_repeated, **limits)
    gone = lost.groupBy("rid").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))
    verdicts = found.where("kept").join(gone, "rid", "left").groupBy("row").agg(F.first("gone").alias("gone"))
    packed = docs.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("all"), F.to_json(key).alias("row"))
    rows = packed.join(verdicts, "row")
    at = docs.columns.index(text)
    return rows.select(*((_without(F.col(f"all.c{i}"), F.col("gone")) if i == at else F.col(f"all.c{i}")).alias(c) for i, c in enumerate(docs.columns)))
