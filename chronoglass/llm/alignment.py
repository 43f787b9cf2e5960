"""Cross-tokenizer alignment: groups of tokens between common ends, links between overlapping ones, and their counts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import handing_back, kept_by_worker, materialise, small_batches, spread_join
from .tokens import _LATIN, _ODD, Encoder

#: Id pairs up to which their counts are broadcast; they are counted first, and more meet in a shuffle.
BROADCAST_PAIRS = 1_000_000
SPACE = "▁"
#: The first character of three bytes.
TWO_BYTES = "\u0800"
#: Texts that are not cut at their spaces: characters that the libraries may read otherwise, or white space by a space that can
#: be in one token with it. In all others a space begins a token on both sides.
WHOLE = r"[^\x{0}-\x{24f}]|[\x{1c}-\x{1f}]|(\A| )[\t-\r \x{85}\x{a0}]| \z"
#: Bytes of texts that are aligned at once, so that their units are few.
SLICE = 8_000_000
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class BytePieces:
    """A byte-level tokenizer's ids of space and text, special tokens' strings as plain text, and each token's bytes.

    The file's merges are in the order of their ids, so these are ranks, by which tiktoken encodes. A file where they are
    not goes through the tokenizers library, and so do texts that are not Latin, as the two may know other versions of
    Unicode's letters.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        own = Encoder(path, 1)
        self.tok = own.tok
        self.tok.encode_special_tokens = True
        byte_of = {chr(b): b for b in range(256)} | {letter: b for b, letter in own.letters.items()}
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        vocabulary = {t: i for t, i in self.tok.get_vocab().items() if t not in special}
        self.bytes = [b""] * (max(self.tok.get_vocab().values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(byte_of.get, token))
        with open(path, "rb") as f:
            merged = [x if isinstance(x, list) else x.split(" ") for x in json.load(f)["model"]["merges"]]
        order = [vocabulary[a + b] for a, b in merged]
        self.ranked = order == sorted(order) and own.spaced
        self.table_of_bytes = pa.array(self.bytes, pa.large_binary())
        self.bpe = tiktoken.Encoding("ids-are-ranks", pat_str=PATTERN, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={}) if self.ranked else None

    def ids(self, text: str) -> np.ndarray:
        if self.ranked and max(text) < _LATIN and not _ODD(text):
            return self.bpe.encode_to_numpy(" " + text, disallowed_special=()).astype(np.int32)
        return np.array(self.tok.encode(" " + text, add_special_tokens=False).ids, np.int32)


class SentencePieces:
    """A sentencepiece BPE model's ids of texts, before which it puts a space, and each piece's bytes.

    The model merges characters in the order of the pieces' scores. Where all characters of a text have one or two bytes,
    merges of bytes give the same if those that make a character come first, then the pieces by score, and what no piece
    holds stays bytes; tiktoken encodes by these ranks, run of spaces and word by word, as no piece holds a space after
    another character. Other texts, and models with other pieces, go through the library.
    """

    def __init__(self, path: str):
        import sentencepiece
        import tiktoken

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        normal = [i for i in range(len(pieces)) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.ranked = not any(SPACE in p.lstrip(SPACE) for p in pieces) and sum(map(m.is_byte, range(len(pieces)))) == 256
        ids, ranks = dict.fromkeys(range(256), 0), {bytes([b]): b for b in range(256)}
        ids |= {self.bytes[i][0]: i for i in range(len(pieces)) if m.is_byte(i)}
        ids |= {self.bytes[i][0]: i for i in normal if len(self.bytes[i]) == 1}
        first = [i for i in normal if len(pieces[i]) == 1 and len(self.bytes[i]) == 2]
        for i in [*first, *sorted((i for i in normal if len(pieces[i]) > 1), key=lambda i: -m.get_score(i))]:
            ids[len(ids)], ranks[self.bytes[i]] = i, len(ids)
        self.table_of_bytes = pa.array(self.bytes, pa.large_binary())
        self.table = np.array(list(ids.values()), np.int32)
        self.bpe = tiktoken.Encoding("scores-are-ranks", pat_str=r" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={}) if self.ranked else None

    def ids(self, text: str) -> np.ndarray:
        if self.ranked and max(text) < TWO_BYTES and SPACE not in text:
            return self.table[self.bpe.encode_to_numpy(" " + text, disallowed_special=())]
        return np.array(self.model.encode(text, num_threads=1), np.int32)


@kept_by_worker
@lru_cache(maxsize=2)
def side(kind: str, path: str) -> BytePieces | SentencePieces:
    return (BytePieces if kind == "a" else SentencePieces)(path)


def _joined(s: BytePieces | SentencePieces, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The tokens' bytes, one after another, and how many there are before each and at last."""
    if not len(ids):
        return memoryview(b""), np.zeros(1, np.int64)
    joined = s.table_of_bytes.take(pa.array(ids))
    return memoryview(joined.buffers()[2] or b"").cast("B"), np.frombuffer(joined.buffers()[1], np.int64)[: len(ids) + 1]


def _encoded(s: BytePieces | SentencePieces, words: list[str], wholes: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all units, words first: their tokens' ids, the bytes of each, how many a unit has, and whether they join to a
    space and the unit. Words are encoded as one text; should a token not end where a word does, they are one by one."""

    def each(units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = [s.ids(t) for t in units]
        flat, n = np.concatenate([np.zeros(0, np.int32), *ids]), np.array([len(x) for x in ids], np.int64)
        data, ends = _joined(s, flat)
        at = ends[np.concatenate([[0], np.cumsum(n)]).astype(np.int64)].tolist()
        return flat, n, np.array([data[x:y] == (" " + t).encode() for t, x, y in zip(units, at[:-1], at[1:], strict=True)], bool)

    flat, n, same = each(wholes)
    if words:
        text = " ".join(words)
        first = s.ids(text)
        data, ends = _joined(s, first)
        stops = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = np.searchsorted(ends, stops)
        if ends[-1] == stops[-1] and (ends[cuts] == stops).all() and data == (" " + text).encode():
            own, held = np.diff(cuts, prepend=0), np.ones(len(words), bool)
        else:
            first, own, held = each(words)
        flat, n, same = np.concatenate([first, flat]), np.concatenate([own, n]), np.concatenate([held, same])
    return flat, np.diff(_joined(s, flat)[1]), n, same


def _sums(n: np.ndarray, at: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Of n at places `at`, the sums between cuts of these places."""
    return np.diff(np.concatenate([[0], np.cumsum(n[at])])[cuts])


def _aligned(sides: list, words: list[str], wholes: list[str], at: np.ndarray, cuts: np.ndarray) -> tuple:
    """Of documents that are units `at` between cuts: n_a, n_b, n_groups, n_links, the text of groups and its cuts, links'
    id pairs once each, how many links each has, and their cuts.

    Both sides' tokens end where a unit does, so groups and links lie within units and a document's are its units', one
    after another: each different unit is aligned once.
    """
    coded = [_encoded(s, words, wholes) for s in sides]
    same = coded[0][3] & coded[1][3]
    ids, ends, n = [], [], []
    for flat, size, k, _ in coded:
        keep = np.repeat(same, k)
        ids.append(flat[keep])
        ends.append(np.cumsum(size[keep]))
        n.append(k * same)
    token_cuts = [np.concatenate([[0], np.cumsum(k)]) for k in n]
    # a link ends wherever a token does, a group where both sides' tokens do
    link_ends = np.union1d(*ends)
    link_at = [np.searchsorted(e, link_ends) for e in ends]
    closes = (ends[0][link_at[0]] == link_ends) & (ends[1][link_at[1]] == link_ends)
    link_cuts = np.searchsorted(link_ends, np.concatenate([[0], ends[0]])[token_cuts[0]], "right")
    group_cuts = np.concatenate([[0], np.cumsum(closes)])[link_cuts]
    common = link_ends[closes]
    # groups' tokens, A's before B's: before a token of A are B's of earlier groups, before one of B A's up to its group's end
    group = [np.searchsorted(common, e) for e in ends]
    until = [np.concatenate([[0], np.searchsorted(e, common, "right")]) for e in ends]
    order = np.empty(sum(map(len, ids)), np.int64)
    order[np.arange(len(ids[0])) + until[1][group[0]]] = 2 * ids[0] + np.isin(ends[0], common, assume_unique=True)
    order[np.arange(len(ids[1])) + until[0][group[1] + 1]] = 2 * (ids[1] + len(sides[0].bytes)) + np.isin(ends[1], common, assume_unique=True)
    texts = _listed(len(sides[0].bytes), len(sides[1].bytes)).take(pa.array(order))
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[token_cuts[0] + token_cuts[1]] if len(order) else np.zeros(len(same) + 1, np.int64)
    of_units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(same), [None, pa.py_buffer(np.ascontiguousarray(offsets)), texts.buffers()[2] or pa.py_buffer(b"")])
    text = of_units.take(pa.array(at))
    text_cuts = (np.frombuffer(text.buffers()[1], np.int64) if len(at) else np.zeros(1, np.int64))[cuts]
    pairs, code = np.unique(ids[0][link_at[0]].astype(np.int64) << 32 | ids[1][link_at[1]], return_inverse=True)
    links = pa.LargeListArray.from_arrays(pa.array(link_cuts), pa.array(code.astype(np.int64))).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
    n_links = _sums(np.diff(link_cuts), at, cuts)
    held = np.sort(np.repeat(np.arange(len(n_links)) * max(1, len(pairs)), n_links) + links)
    first = np.flatnonzero(np.concatenate([held[:1] >= 0, held[1:] != held[:-1]]))
    times = np.diff(np.append(first, len(held)))
    document, code = np.divmod(held[first], max(1, len(pairs)))
    pair_cuts = np.searchsorted(document, np.arange(len(n_links) + 1))
    return *(_sums(k, at, cuts) for k in n), _sums(np.diff(group_cuts), at, cuts), n_links, text, text_cuts, pairs[code], times, pair_cuts


@lru_cache(maxsize=1)
def _listed(a: int, b: int) -> pa.Array:
    """Ids as text, A's from 0 to a and B's from 0 to b: each before `,` and as the last of its group's."""
    return pa.array([f"{i}{mark}".encode() for n, last in ((a, "|"), (b, ";")) for i in range(n) for mark in (",", last)], pa.large_binary())


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Places from and to of rows with about SLICE bytes together."""
    part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return zip(cuts[:-1], cuts[1:], strict=True)


def _align(path_a: str, path_b: str):
    held = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))
    kinds = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups_sha256", pa.string()), ("pairs", held)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = [side("a", path_a), side("b", path_b)]
        for batch in batches:
            if not len(batch):
                continue
            for low, high in _slices(pc.fill_null(batch.column(2), "")):
                b = batch.slice(low, high - low)
                texts = pc.fill_null(b.column(2), "")
                full = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
                whole = pc.match_substring_regex(texts, WHOLE).to_numpy(zero_copy_only=False) | (not all(s.ranked for s in sides))
                cut, rest = np.flatnonzero(full & ~whole), np.flatnonzero(full & whole)
                parts = pc.split_pattern(texts.take(pa.array(cut)), " ")
                words, wholes = parts.flatten().dictionary_encode(), texts.take(pa.array(rest)).to_pylist()
                n = np.zeros(len(b), np.int64)  # units of each row, in the order of cut, rest and those without
                n[: len(cut)], n[len(cut) : len(cut) + len(rest)] = pc.list_value_length(parts).to_numpy(zero_copy_only=False), 1
                at = np.concatenate([words.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.arange(len(rest)) + len(words.dictionary)])
                *counts, text, text_cuts, pairs, times, pair_cuts = _aligned(sides, words.dictionary.to_pylist(), wholes, at, np.concatenate([[0], np.cumsum(n)]))
                data = memoryview(text.buffers()[2] or b"").cast("B") if len(text) else memoryview(b"")
                digests = [hashlib.sha256(data[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(text_cuts[:-1].tolist(), text_cuts[1:].tolist(), strict=True)]
                rows = b.select([0, 1]).take(pa.array(np.concatenate([cut, rest, np.flatnonzero(~full)])))
                listed = pa.ListArray.from_arrays(pa.array(pair_cuts.astype(np.int32)), pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], fields=list(held.value_type)))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(c.astype(np.int64)) for c in counts), pa.array(digests, pa.string()), listed], schema=kinds)

    return run


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs) of space and text: groups end where both sides'
    tokens do, links are the pairs of tokens that overlap, pairs are their different ids (A's in the high 32 bits) with the
    number of links of each. A text that is null, empty, or not what either side's tokens' bytes join to has none."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(handing_back(_align(path_a, path_b)), f"rid long, doc_id long, {counts}, groups_sha256 string, pairs array<struct<pair: long, times: long>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best) of align(), written: in how many documents an id pair is linked, and whether no other pair of
    its A id is in more. An A id has at most as many pairs as B has ids."""
    counts = aligned.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    top = F.max("n_docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return materialise(counts.withColumn("best", F.col("n_docs") == top), "pair-counts")


def alignment(docs: DataFrame, path_a: str, path_b: str, text: str = "text", doc_id: str = "doc_id", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    path_a is a byte-level tokenizers file, read on a space and the text, path_b a sentencepiece model, which puts that
    space itself. n_best counts links whose id pair is in as many documents as any of its A id's, count_sum adds up the
    number of documents of each link's pair. Texts that are null or empty, or that one of the two can't give back byte for
    byte, have no tokens, all zeros and an empty groups_sha256. Repeated rows count as documents each; a null identifier
    stays null. An empty table gives no row.

    Python tokenises and aligns, which is within a document; pairs are pre-aggregated there before Spark counts them, and
    counts come back by a broadcast of checked size or, beyond it, by a join that spreads common pairs.
    """
    aligned = materialise(align(docs, path_a, path_b, text, doc_id), "aligned")
    counts = pair_counts(aligned)
    held = aligned.select("rid", F.inline("pairs"))
    if counts.count() <= broadcast_pairs:
        met = held.join(F.broadcast(counts), "pair")
    else:
        met = spread_join(materialise(held, "pairs-held"), counts, ["pair"])
    sums = met.groupBy("rid").agg(F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return aligned.drop("pairs").join(sums, "rid", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
