"""Language ID: script ranges narrow candidates, Viterbi over per-word scores with a switching penalty."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handing_back, small_batches

#: Labelled documents per language that the model is fitted on, in expectation; buckets of its trigram tables.
FIT_DOCS, BUCKETS, PENALTY, SMOOTH = 1500, 1 << 16, 6.0, 0.3
SCRIPT_SHARE = 0.01
#: Languages at most: the model, BUCKETS floats of four bytes for each, goes to every task, and so is 256 MB at most.
LANGS = 1000
CHUNK = 1_000_000
# First code point of each block of scripts, and the script's number (0: Latin and all that is not listed).
SCRIPTS = [(0x0, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 0), (0x900, 6), (0x980, 7), (0xA00, 8), (0xB80, 9), (0xC00, 10), (0xE00, 11), (0xE80, 0), (0x10A0, 12), (0x1100, 13), (0x1200, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 14), (0x3100, 0), (0x3400, 15), (0xA000, 0), (0xAC00, 13), (0xD7B0, 0), (0xF900, 15), (0xFB00, 0), (0x20000, 15), (0x32000, 0)]


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: lower case if that is one code point, else itself; whether it is a letter."""
    lower, letter = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            x = chr(c)
            if x.isalpha():
                letter[c] = True
                y = x.lower()
                if len(y) == 1:
                    lower[c] = ord(y)
    return lower, letter


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Of texts joined: lower-cased code points, words' starts and ends, the text of each word, texts' starts."""
    lower, letter = _tables()
    at = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), "<u4")
    flags = letter[codes].view(np.int8)
    edge = np.diff(np.concatenate([[0], flags, [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return lower[codes], starts, ends, np.searchsorted(at, starts, side="right") - 1, at


def _grams(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of the words, each word between two marks, and where each word's trigrams begin."""
    n = ends - starts
    first = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
    place = np.arange(int(n.sum())) - np.repeat(first, n)
    at = np.repeat(starts, n) + place
    mid = codes[at].astype(np.uint64)
    prev = np.where(place > 0, codes[np.maximum(at - 1, 0)], 2).astype(np.uint64)
    last = np.where(place < np.repeat(n, n) - 1, codes[np.minimum(at + 1, len(codes) - 1)], 3).astype(np.uint64)
    h = (prev * np.uint64(0x9E3779B97F4A7C15)) ^ (mid * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (last * np.uint64(0x165667B19E3779F9))
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS, first


def _scripts(codes: np.ndarray) -> np.ndarray:
    starts, which = np.array([s for s, _ in SCRIPTS]), np.array([k for _, k in SCRIPTS])
    return which[np.searchsorted(starts, codes, side="right") - 1]


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: log shares of trigrams
    scripts: np.ndarray  # scripts x languages: whether the language uses the script


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHUNK and i > at:
            yield at, i
            at, size = i, len(t)
    yield at, len(texts)


def _counter(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), BUCKETS + 16), np.int64)
        for b in batches:
            texts, which = b.column(0).to_pylist(), np.array([place[x] for x in b.column(1).to_pylist()])
            for i, j in _chunks(texts):
                codes, s, e, doc, _ = _words(texts[i:j])
                grams, first = _grams(codes, s, e)
                lang = which[i:j][doc]
                np.add.at(counts, (np.repeat(lang, e - s), grams), 1)
                np.add.at(counts, (lang, BUCKETS + _scripts(codes[s])), 1)
        k, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(g, pa.int32()), pa.array(counts[k, g])], names=["k", "g", "n"])

    return run


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", fit_docs: int = FIT_DOCS) -> Model:
    """Trigram counts of a bounded sample: of each language, documents whose hashed identifier falls below fit_docs / its
    count, so about fit_docs of them. Rows with null text or language are not learnt from. What comes to the driver is
    languages x BUCKETS counts at most; over LANGS languages are refused."""
    docs = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(F.lit("fit"), F.col(doc_id)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().limit(LANGS + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > LANGS:
        raise ValueError(f"over {LANGS} languages")
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((16, 0), bool))
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, fit_docs / sizes[k]))))[F.col("lang")]
    small_batches(docs.sparkSession)
    sample = docs.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003).select("text", "lang")
    counts = np.zeros((len(langs), BUCKETS + 16))
    for r in sample.mapInArrow(handing_back(_counter(langs)), "k int, g int, n long").groupBy("k", "g").agg(F.sum("n").alias("n")).toPandas().itertuples():
        counts[r.k, r.g] = r.n
    grams, scripts = counts[:, :BUCKETS] + SMOOTH, counts[:, BUCKETS:]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return Model(langs, np.ascontiguousarray(table), (scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts.T > 0))


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best label of each word when changing labels costs penalty; scores: the words of all texts in order, lengths: words
    per text. All texts advance together, a word at a time, longest first."""
    k, path = scores.shape[1], np.zeros(len(scores), np.int64)
    order = np.argsort(-lengths, kind="stable")
    size, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")  # texts with over t words
    own, back, best = np.arange(k), np.zeros(scores.shape, np.int8 if k < 128 else np.int16), np.zeros((len(size), k), np.float32)
    for t in range(steps):
        a = active[t]
        rows = begin[:a] + t
        if t == 0:
            best[:a] = scores[rows]
            continue
        prev = best[:a]
        other = prev.max(axis=1, keepdims=True) - penalty
        back[rows] = np.where(prev >= other, own, prev.argmax(axis=1)[:, None])
        best[:a] = np.maximum(prev, other) + scores[rows]
    label = best.argmax(axis=1) if steps else np.zeros(len(size), int)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        rows = begin[:a] + t
        path[rows] = label[:a]
        if t:
            label[:a] = back[rows, label[:a]]
    return path


def label_texts(model: Model, texts: list[str], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
    """For each text the language of most words' letters, that share, and spans (language, start, end) in code points."""
    out = [("und", 0.0, [])] * len(texts)
    codes, s, e, doc, at = _words(texts)
    if not len(s) or not model.langs:
        return out
    grams, first = _grams(codes, s, e)
    scores = np.add.reduceat(model.table[grams], first, axis=0)
    fits = model.scripts[_scripts(codes[s])]
    fits |= ~fits.any(axis=1, keepdims=True)
    scores = np.where(fits, scores, scores.min(axis=1, keepdims=True) - 50).astype(np.float32)
    path = viterbi(scores, np.bincount(doc, minlength=len(texts)), penalty)
    letters = np.zeros((len(texts), len(model.langs)))
    np.add.at(letters, (doc, path), e - s)
    change = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(path) != 0)]))
    until = np.concatenate([change[1:], [len(doc)]]) - 1
    spans: dict[int, list] = {}
    for d, k, x, y in zip(doc[change].tolist(), path[change].tolist(), (s[change] - at[doc[change]]).tolist(), (e[until] - at[doc[change]]).tolist(), strict=True):
        spans.setdefault(d, []).append((model.langs[k], x, y))
    top, share = letters.argmax(axis=1), letters.max(axis=1) / np.maximum(letters.sum(axis=1), 1)
    for d in spans:
        out[d] = (model.langs[top[d]], float(share[d]), spans[d])
    return out


def _labeller(model: Model, penalty: float):
    kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            found = [x for i, j in _chunks(texts) for x in label_texts(model, texts[i:j], penalty)]
            spans = [[{"lang": k, "start": x, "end": y} for k, x, y in f[2]] for f in found]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)], names=[*b.schema.names[:-1], "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None, penalty: float = PENALTY) -> DataFrame:
    """The columns in carry, then lang_pred, score and spans (array of lang, start, end) of every whole text.

    Script blocks of a word's first letter leave the languages that use that script; each word gets the log share of its
    trigrams in each; Viterbi labels all words. lang_pred has the most letters, score is their part of all letters. A
    null text, or one without a letter, is `und` with score 0 and no span. A tie goes to the first language by name. The
    model is sent along with the tasks: BUCKETS x languages floats.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(*(carry or []), F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(handing_back(_labeller(model, penalty)), (schema + ", " if schema else "") + "lang_pred string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0
