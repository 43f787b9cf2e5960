"""Benchmark decontamination: rare n-gram seeds join passages to items, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import handing_back, materialise, row_key, small_batches, spread_join, without_rows

#: Words of a seed: the fewest at which few items hold it. At the most, it counts as a leak by itself.
LADDER = (3, 5, 8, 13)
#: Items that may share a seed; one that more share gives way to the longer ones around it.
SEED_ITEMS = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Part of the score of a perfect copy at which a passage counts as leaked.
LEAK = 0.5
#: Or the words in a row whose score counts as leaked, however long the item.
LEAK_WORDS = 13
#: Bits of the seeds' filter for each seed, and at most (32 MB, which is what goes to every task); places in it that a
#: seed sets. A filter that is too full lets more n-grams into the join and loses none.
FILTER_BITS, FILTER_LOG, FILTER_PLACES = 32, 28, 4
#: Bytes of the items' words up to which they are broadcast; their sum is checked.
BROADCAST_BYTES = 64_000_000
STORE = 400_000
_MIX = (np.random.default_rng(17).integers(1, 2**63, FILTER_PLACES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def norm(token: str) -> str:
    """A word without what is not a letter or digit at its ends, in lower case."""
    i, j = 0, len(token)
    while i < j and not token[i].isalnum():
        i += 1
    while j > i and not token[j - 1].isalnum():
        j -= 1
    return token[i:j].lower()


class _Words(dict):
    """Token to its word's 64-bit hash; 0 for tokens without a letter or digit."""

    def __missing__(self, token: str) -> int:
        w = norm(token)
        self[token] = h = (xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) or 1) if w else 0
        return h


@lru_cache(maxsize=1)
def _store() -> _Words:
    return _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of a text's words; tokens without a letter or digit are left out."""
    store = _store()
    if len(store) > STORE:
        store.clear()
    tokens = (text or "").split()
    out = np.fromiter(map(store.__getitem__, tokens), np.uint64, len(tokens))
    return out[out != 0]


def gram_codes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code for each n-gram of `width` words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = (out ^ words[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def filter_places(codes: np.ndarray, log: int) -> np.ndarray:
    """FILTER_PLACES places of each code in a filter of 2**log bits."""
    return ((codes.view(np.uint64)[:, None] * _MIX) >> np.uint64(64 - log)).astype(np.int64)


def passes(codes: np.ndarray, bits: np.ndarray, log: int) -> np.ndarray:
    ok = np.ones(len(codes), bool)
    for mix in _MIX:
        at = ((codes.view(np.uint64) * mix) >> np.uint64(64 - log)).astype(np.int64)
        ok &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def most(item: np.ndarray, window: np.ndarray) -> int:
    """The most that an alignment in the window can score: a match for each word that both have, as often as both do."""
    words, times = np.unique(item, return_counts=True)
    if not len(words):
        return 0
    k = np.minimum(np.searchsorted(words, window), len(words) - 1)
    have = np.bincount(k[words[k] == window], minlength=len(words))
    return MATCH * int(np.minimum(have, times).sum())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local score of item against window, and the place in window after its last aligned word."""
    steps = np.arange(len(window) + 1) * GAP
    above, top, at = np.zeros(len(window) + 1, np.int64), 0, 0
    for w in item:
        here = np.zeros_like(above)
        here[1:] = np.maximum(above[:-1] + np.where(window == w, MATCH, MISMATCH), above[1:] + GAP)
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here - steps) + steps
        k = int(here.argmax())
        if here[k] > top:
            top, at = int(here[k]), k
        above = here
    return top, at


def slack(words: int) -> int:
    """Words around an item's place that an edited copy may take more."""
    return words // 2 + 4


def best_passage(item: np.ndarray, words: np.ndarray, starts: np.ndarray, leak: float = LEAK, row: int = LEAK_WORDS) -> tuple | None:
    """(score, first word, word after the last) of the best alignment of item in words near the starts that seeds give it,
    if it reaches the score that counts as leaked."""
    best, need, room = None, MATCH * min(leak * len(item), row), slack(len(item))
    for part in np.split(starts, np.flatnonzero(np.diff(starts) > room) + 1):
        a, b = max(0, int(part[0]) - room), min(len(words), int(part[-1]) + len(item) + room)
        if most(item, words[a:b]) < need:
            continue
        score, end = align(item, words[a:b])
        if score >= need and (best is None or score > best[0]):
            best = (score, max(a, a + end - len(item)), a + end)
    return best


def _words_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([word_hashes(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())], names=["ino", "item_id", "item"])


def _seeds_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All n-grams of each item at each step of the ladder, the last of which is the whole item if that is short."""
    for b in batches:
        for ino, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = np.frombuffer(raw, np.uint64)
            for step, width in enumerate(sorted({min(w, len(words)) for w in LADDER} - {0})):
                codes = gram_codes(words, width)
                n = len(codes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ino)), pa.array(codes), pa.array(np.arange(n)), pa.array(np.full(n, width)), pa.array(np.full(n, step)), pa.array(np.full(n, width == min(LADDER[-1], len(words))))], names=["ino", "code", "q", "width", "step", "last"])


def rare_seeds(grams: DataFrame, items: int = SEED_ITEMS) -> DataFrame:
    """(ino, code, q, width), written: of an item's n-grams, those that at most `items` items hold, or that are the
    ladder's last, but for longer ones that need none: at each step only n-grams around one too common of the step before
    go on. So a passage that shares a rare n-gram with an item meets it, and a common n-gram alone brings nobody together."""
    spark, out = grams.sparkSession, None
    held = grams.groupBy("code").agg(F.count_distinct("ino").alias("items"))
    grams = materialise(grams.join(held, "code").withColumn("common", (F.col("items") > items) & ~F.col("last")), "seeds-all")
    open_at = None
    for step in range(len(LADDER)):
        here = grams.where(F.col("step") == step)
        if open_at is not None:
            around = open_at.withColumnRenamed("width", "short").withColumn("long", F.least(F.lit(LADDER[step]), F.col("n")))
            around = around.select("ino", F.explode(F.sequence(F.greatest(F.col("q") + F.col("short") - F.col("long"), F.lit(0).cast("long")), F.least("q", F.col("n") - F.col("long")))).alias("q")).distinct()
            here = here.join(around, ["ino", "q"], "left_semi")
        here = materialise(here, "seeds-step")
        found = here.where("NOT common").select("ino", "code", "q", "width")
        out = found if out is None else out.unionByName(found)
        sizes = grams.groupBy("ino").agg(F.max(F.col("q") + F.col("width")).alias("n"))
        open_at = here.where("common").select("ino", "q", "width").join(sizes, "ino")
        if open_at.isEmpty():
            break
    return materialise(out, "seeds") if out is not None else spark.createDataFrame([], "ino long, code long, q long, width long")


def _set_bits(log: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(filter_places(b.column(0).to_numpy(), log))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 15), pa.array(at & 32767)], names=["part", "bit"])

    return run


def _passages(bits: np.ndarray, log: int, widths: list[int], reach: int):
    kinds = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.string()), ("begin", pa.int64()), ("words", pa.binary()), ("codes", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for rid, doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words, codes, places = word_hashes(text), [], []
                for width in widths:
                    c = gram_codes(words, width)
                    at = np.flatnonzero(passes(c, bits, log))
                    codes.append(c[at])
                    places.append(at)
                codes, places = np.concatenate(codes), np.concatenate(places)
                if not len(places):
                    continue
                order = np.argsort(places, kind="stable")
                codes, places = codes[order], places[order]
                cuts = np.flatnonzero(np.diff(places) > 2 * reach) + 1
                for c, p in zip(np.split(codes, cuts), np.split(places, cuts), strict=True):
                    begin = max(0, int(p[0]) - reach)
                    out.append((rid, doc, key, begin, words[begin : int(p[-1]) + reach].tobytes(), c, p - begin))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return run


def _align(leak: float):
    kinds = pa.schema([("rid", pa.int64()), ("ino", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.string()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("seeds", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for ino, starts, item_id, item, rid, doc, key, begin, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                item = np.frombuffer(item, np.uint64)
                best = best_passage(item, np.frombuffer(words, np.uint64), np.array(starts, np.int64), leak)
                if best:
                    out.append((rid, ino, doc, key, item_id, best[0] / (MATCH * len(item)), begin + best[1], begin + best[2], len(starts)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return run


def contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", leak: float = LEAK) -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word, seeds): a row per row of docs and item with a passage like the item.

    Seeds are the items' n-grams of three words that at most SEED_ITEMS items hold; around those that more items hold, of
    five, eight and at last thirteen words, or the whole item. How many documents hold one doesn't matter: a passage that
    leaked often is common for that. So an n-gram brings a passage to few items, unless it is a leak itself. One pass over the documents keeps the n-grams that a filter of the seeds, of bounded
    size, lets through, with the words around them as far as an edited copy may reach. They join the seeds, so that each
    passage meets the items it shares one with, and there the item is aligned, unless the words can't score enough in any
    order. Items whose best local alignment (match 2, mismatch and gap -1) reaches `leak` of a perfect copy's score, or
    that of LEAK_WORDS words in a row, are found. score is the part of a perfect copy's, 1 for a copy; words count
    without bare punctuation; seeds is the number of n-grams shared around there. So a passage that reaches the score is
    found if three words in a row survive in it that few items share, or more words in a row where these are in many.

    Frequent n-grams, long documents and frequent items are met by spread_join. Null or empty texts and items match
    nothing; items of fewer than three words match all their words in a row; a null identifier is carried as null;
    repeated rows and items are reported each; of equally good passages of an item in a row the first is.
    """
    return _contaminated(docs, bench, text, doc_id, item_id, leak).drop("row_key")


def _contaminated(docs: DataFrame, bench: DataFrame, text: str, doc_id: str, item_id: str = "item_id", leak: float = LEAK) -> DataFrame:
    """contaminated() with row_key."""
    spark = docs.sparkSession
    small_batches(spark)
    items = bench.select(F.monotonically_increasing_id().alias("ino"), F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    items = materialise(items.mapInArrow(_words_of_items, "ino long, item_id long, item binary"), "items")
    seeds = rare_seeds(items.select("ino", "item").mapInArrow(_seeds_of_items, "ino long, code long, q long, width long, step long, last boolean"))
    size, longest = items.agg(F.sum(F.length("item")), F.max(F.length("item"))).first()
    widths = sorted(r["width"] for r in seeds.select("width").distinct().collect())  # 1 to 13
    log = min(FILTER_LOG, max(16, int(np.ceil(np.log2(max(1, FILTER_BITS * seeds.count()))))))
    bits = np.zeros(1 << log - 3, np.uint8)
    set_bits = seeds.select("code").mapInArrow(_set_bits(log), "part long, bit long").groupBy("part").agg(F.call_function("bitmap_construct_agg", "bit").alias("bits"))
    for r in set_bits.collect():
        bits[r["part"] << 12 : (r["part"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), row_key(text, doc_id).alias("row_key"), F.col(text).cast("string").alias("text"))
    if not widths:
        rows = rows.limit(0)
    reach = (longest or 0) // 8 + slack((longest or 0) // 8) + LADDER[-1]
    found = rows.mapInArrow(handing_back(_passages(bits, log, widths, reach)), "rid long, doc_id long, row_key string, begin long, words binary, codes array<long>, places array<long>")
    found = materialise(found.withColumn("pid", F.monotonically_increasing_id()), "passages")
    grams = materialise(found.select("pid", F.explode(F.arrays_zip("codes", "places")).alias("g")).select("pid", F.col("g.codes").alias("code"), F.col("g.places").alias("p")), "grams")
    held = seeds.groupBy("code").agg(F.collect_list(F.struct("ino", "q")).alias("held"))  # of few items, or of equal passages
    starts = spread_join(grams, held, ["code"]).select("pid", "p", F.explode("held").alias("s")).select("pid", "p", "s.ino", "s.q").groupBy("pid", "ino").agg(F.sort_array(F.collect_list(F.col("p") - F.col("q"))).alias("starts"))
    starts = materialise(starts, "starts")
    passages = found.select("pid", "rid", "doc_id", "row_key", "begin", "words")
    if (size or 0) <= BROADCAST_BYTES:
        pairs = spread_join(starts, passages, ["pid"]).join(F.broadcast(items), "ino")
    else:
        pairs = spread_join(materialise(spread_join(starts, items, ["ino"]), "items-met"), passages, ["pid"])
    pairs = pairs.select("ino", "starts", "item_id", "item", "rid", "doc_id", "row_key", "begin", "words")
    aligned = pairs.mapInArrow(handing_back(_align(leak)), "rid long, ino long, doc_id long, row_key string, item_id long, score double, first_word long, end_word long, seeds long")
    best = aligned.groupBy("rid", "ino").agg(F.max_by(F.struct("doc_id", "row_key", "item_id", "score", "first_word", "end_word"), F.struct("score", -F.col("first_word"))).alias("b"), F.sum("seeds").alias("seeds"))
    return best.select("b.*", "seeds")


def drop_contaminated(docs: DataFrame, bench: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows that hold a benchmark passage, whatever their identifiers; columns as they are."""
    return without_rows(docs, _contaminated(docs, bench, text, doc_id).select("row_key"), text, doc_id)
