"""SimHash near-dedup: fingerprints, pigeonhole blocks, verified Hamming distance, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import handing_back, keyed_rows, made, materialise, remove, small_batches, spread_join, unkeyed_rows, whole
from .graph import components

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: A pair within 3 bits agrees on at least 3 of 6 blocks: 20 choices of 3, each with a key of 32 or 33 bits.
BLOCK_BITS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of one key that are compared in one place; more are dealt into chunks, and pairs of chunks are compared.
GROUP = 4096
#: Near copies by similarity: words of a shingle, least similarity, bits of a fingerprint.
WORDS, SIMILARITY, WIDE = 5, 0.8, 512
#: The largest share of differing bits that a pair at 0.8 is expected to have, that of 4 shingles within 5, where sums tie
#: often; larger sets come to 0.15. A pair is a candidate up to so many standard deviations more.
TIED_SHARE, DEVIATIONS = 3 / 16, 5
#: All pairs of groups up to this size are candidates at once; in larger ones, those that first links leave apart.
SMALL = 32
#: Rounds at most in which each set of a large group is compared to the nearest one that links leave apart, before all that
#: are still apart are compared, and the share of a round's pairs that must be links for another. They only settle how many
#: pairs need no comparison.
ROUNDS, FRUITFUL = 6, 0.1
#: Documents, taken by hash, whose shingles tell which ones are common, and how many of these are known to the tasks. It
#: only settles an order, so the result does not depend on it.
ORDER_DOCS, ORDER_TERMS = 5000, 50_000
LINKS = "wide-links"
#: Texts to compare are picked from the corpus by a broadcast of their hashes up to this number (some 60 bytes each), which is
#: counted; more meet in a shuffle of all texts.
BROADCAST_ENDS = 250_000
#: Groups up to this size are compared as one matrix.
MATRIX = 256
#: Fingerprints whose keys are made at once, as each becomes many rows.
PIECE = 100


def block_masks(bits: tuple = BLOCK_BITS, distance: int = DISTANCE) -> list[int]:
    starts = np.concatenate([[0], np.cumsum(bits)])
    blocks = [((1 << b) - 1) << int(s) for b, s in zip(bits, starts, strict=False)]
    return [sum(c) for c in combinations(blocks, len(bits) - distance)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64 bits; a bit is 1 if over half of the shingles' hashes have it. No word: 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)), strict=False)] if len(words) >= width else [b" ".join(words)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(grams), 8192):
        h = np.array([digest(g, SEED) for g in grams[i : i + 8192]], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp) of every whole text."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(handing_back(_fingerprints), "doc_id long, fp long")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one 64-bit word, or of several along the last axis."""
    bits = np.bitwise_count(a ^ b)
    return bits.sum(axis=-1, dtype=np.int64) if max(a.ndim, b.ndim) > 1 else bits


def cluster(fps: np.ndarray, distance: int) -> np.ndarray:
    """For each of some distinct fingerprints the least index it is linked to, by any chain of links among them."""
    n, root = len(fps), np.full(len(fps), -1)
    if fps.ndim > 1 and n <= MATRIX and (differing(fps[:, None], fps[None]) <= distance).sum() == n:
        return np.arange(n)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], todo = seed, [seed]
        free = np.flatnonzero(root < 0)
        while todo and len(free):
            near = differing(fps[free], fps[todo.pop()]) <= distance
            hit = free[near]
            if len(hit):
                root[hit] = seed
                todo.extend(hit.tolist())
                free = free[~near]
    return root


def _links(distance: int):
    """Sorted rows of (t, k, i, j, fp), or of (t, k, i, j, node, fp) with fp in bytes, to links (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in _with_end(batches):
            if b is not None:
                new = [np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64), b.column(4).to_numpy(zero_copy_only=False)]
                new.append(new[1].view(np.uint64) if b.num_columns == 5 else np.frombuffer(b"".join(b.column(5).to_pylist()), "<u8").reshape(b.num_rows, -1))
                keys, names, fps = new if carry is None else [np.concatenate(x) for x in zip(carry, new, strict=True)]
                if not len(names):
                    continue
                new = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
                end = int(new[-1]) if len(new) else 0
                carry, names, fps, bounds = (keys[end:], names[end:], fps[end:]), names[:end], fps[:end], np.concatenate([[0], new])
            elif carry is not None:
                names, fps, bounds = carry[1], carry[2], np.array([0, len(carry[1])])
            else:
                return
            sizes = np.diff(bounds)
            a, z = [], []
            two = bounds[:-1][sizes == 2]
            near = differing(fps[two], fps[two + 1]) <= distance
            a.append(names[two][near])
            z.append(names[two + 1][near])
            for s, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
                part = names[s : s + n]
                root = cluster(fps[s : s + n], distance)
                linked = root != np.arange(n)
                a.append(part[root[linked]])
                z.append(part[linked])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).astype(np.int64)), pa.array(np.concatenate(z).astype(np.int64))], names=["u", "v"])

    return run


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(fps: DataFrame, distance: int = DISTANCE, group: int = GROUP) -> DataFrame:
    """(u, v): for every key of the blocks a spanning forest of the links among its fingerprints, not all pairs.

    fps: distinct fingerprints (fp), a written table. Keys with over max(group, rows/1e6) fingerprints are under a
    million, which bounds what is broadcast; theirs are dealt into chunks of that size, and every pair of chunks is
    compared, so no link is lost and no task gets an unbounded group.
    """
    masks = [m - (1 << 64) if m >> 63 else m for m in block_masks(distance=distance)]
    keys = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)))).alias("b")).select("fp", "b.t", "b.k")
    return _compared(keys, keys, ["fp"], fps.count() * len(masks), distance, group)


def _compared(keys: DataFrame, counted: DataFrame, carry: list[str], rows: int, distance: int, group: int) -> DataFrame:
    """Links among the rows of keys (carry, t, k) that share t and k; counted has the same t and k, rows times."""
    return _dealt(keys, counted, carry, rows, group).mapInArrow(handing_back(_links(distance)), "u long, v long")


def _dealt(keys: DataFrame, counted: DataFrame, carry: list[str], rows: int, group: int) -> DataFrame:
    """Rows of keys sorted by (t, k, i, j); i and j are the chunks of a large key that are to be compared."""
    limit = max(group, rows // 1_000_000)
    large = materialise(counted.groupBy("t", "k").agg(F.count("*").alias("rows")).where(F.col("rows") > limit), "large-keys")
    keys = keys.join(F.broadcast(large.limit(1_000_000)), ["t", "k"], "left")
    chunks = F.ceil(F.coalesce("rows", F.lit(1)) / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(carry[0]), chunks).cast("int")
    pairs = F.when(chunks == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(c, own).alias("i"), F.greatest(c, own).alias("j")))
    )
    dealt = keys.select(*carry, "t", "k", F.explode(pairs).alias("p")).select("t", "k", "p.i", "p.j", *carry)
    return dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j", carry[0])


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id (the smallest identifier reachable, itself included).

    Equal fingerprints collapse before the blocks, so copies cost nothing further. Null and empty texts have fingerprint
    0 and are linked like any other. A component whose identifiers are all null has a null component_id; rows that share
    an identifier are rows of their own. Other columns don't matter.
    """
    prints = materialise(fingerprints(docs, text, doc_id), "prints")
    fps = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    edges = materialise(links(fps.select("fp"), distance).distinct(), "links")
    roots = components(edges)
    known = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = materialise(known, "roots")
    first = known.groupBy("root").agg(F.min("least").alias("component_id"))
    whole = materialise(spread_join(known, first, ["root"]).select("fp", "component_id"), "members")
    return spread_join(prints, whole, ["fp"]).select("doc_id", "fp", "component_id")


_LANES = np.random.default_rng(SEED).integers(1, 2**63, WIDE // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: For each byte, its bits as the bytes of a 64-bit word, so that 255 bytes can be counted bit by bit in one sum.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
_TIES = np.random.default_rng([SEED, WIDE]).integers(0, 2, WIDE).astype(bool)


def shingle_hashes(text: str | None, width: int = WORDS) -> np.ndarray:
    """Hashes of the different shingles, in order; a text under `width` words is one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(width)), strict=False)] if len(words) >= width else [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(g, SEED) for g in grams), np.uint64, len(grams)))


def wide_bits(h: np.ndarray) -> bytes:
    """WIDE bits; a bit is 1 if over half of the hashes have it; a tie goes as _TIES has it, not as one of the hashes, which
    the other of two similar sets may lack. No hash: 0."""
    if not len(h):
        return bytes(WIDE // 8)
    ones = np.zeros(WIDE, np.int64)
    for i in range(0, len(h), 255):
        x = h[i : i + 255, None] * _LANES
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        ones += _SPREAD[x.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits((2 * ones > len(h)) | (_TIES & (2 * ones == len(h))), bitorder="little").tobytes()


def wide_fingerprint(text: str | None, width: int = WORDS) -> bytes:
    return wide_bits(shingle_hashes(text, width))


def expected_share(similarity: float) -> float:
    """Share of differing bits that two sets of this Jaccard similarity, equally large, are expected to have; sets of
    different size have less."""
    return acos(2 * similarity / (1 + similarity)) / pi


def wide_distance(similarity: float = SIMILARITY, deviations: float = 1, least: float = 0.0) -> int:
    """Bits that a pair at the similarity is expected to differ by, or the share `least` of all, and deviations more."""
    r = max(expected_share(similarity), least)
    return int(WIDE * r + deviations * sqrt(WIDE * r * (1 - r)))


def prefix_length(n: int, similarity: float = SIMILARITY) -> int:
    """Of two sets of at least this similarity, the first so many of each, in one order for all, have one in common: a set
    of n shares `similarity` of its n with the other at least."""
    return n - ceil(similarity * n - 1e-9) + 1 if n else 0


def may_reach(n: np.ndarray, at: np.ndarray, n2: np.ndarray, at2: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two sets of n and n2, whose first shingle in common is at these places of the order, can be as similar: no
    more is in common than what follows there. A pair that meets under several keys passes under the first if at all."""
    return np.minimum(n - at, n2 - at2) + 1e-9 >= similarity / (1 + similarity) * (n + n2)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= similarity * (len(a) + len(b) - both)


def _common_shingles(rows: DataFrame) -> dict[int, int]:
    """Shingles' hashes (as signed numbers) that several of a sample of texts have, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t).view(np.int64) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["k"])

    part = max(1, rows.count() // ORDER_DOCS)
    some = rows.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0).select("text")
    counts = some.mapInArrow(handing_back(run), "k long").groupBy("k").agg(F.count("*").alias("n")).where("n > 2")
    return {r["k"]: r["n"] for r in counts.orderBy(F.desc("n"), "k").limit(ORDER_TERMS).collect()}


def _wide_prints(common: dict[int, int], similarity: float):
    known = np.array(sorted(common), np.int64)
    times = np.array([common[k] for k in known.tolist()], np.int64)

    def prefix(h: np.ndarray) -> bytes:
        k = h.view(np.int64)
        rank = np.zeros(len(k), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, k), len(known) - 1)
            rank = np.where(known[at] == k, times[at], 0)
        return k[np.lexsort((k, rank))[: prefix_length(len(k), similarity)]].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sids, fps, firsts, sizes = [], [], [], []
            for t in b.column(2).to_pylist():
                h = shingle_hashes(t)
                sizes.append(len(h))
                sids.append(xxhash.xxh3_128_digest(h.tobytes()))
                fps.append(wide_bits(h))
                firsts.append(prefix(h))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, pa.binary()) for x in (sids, fps, firsts)), pa.array(sizes, pa.int64())], names=["doc_id", "body", "sid", "fp", "prefix", "n"])

    return run


def _prefix_keys(whole_row: bool):
    """(node, n, fp, prefix) to a row for each shingle of the prefix, with its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
            firsts = b.column(3).to_pylist()
            k = np.frombuffer(b"".join(firsts), np.int64)
            own = [pa.array(np.zeros(len(k), np.int32)), pa.array(k)]
            if not whole_row:
                yield pa.RecordBatch.from_arrays(own, names=["t", "k"])
                continue
            sizes = np.array([len(x) // 8 for x in firsts], np.int64)
            row = pa.array(np.repeat(np.arange(b.num_rows), sizes))
            place = pa.array(np.arange(len(k)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), place, b.column(1).take(row), b.column(2).take(row), *own], names=["node", "at", "n", "fp", "t", "k"])

    return run


def _sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int = 4) -> Iterator[tuple]:
    """Sorted rows, keys first, numbers next, fp last, as (keys, numbers, fps, bounds), where no group is cut."""
    carry = None
    for b in _with_end(batches):
        if b is not None:
            numbers = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns - 1)]).astype(np.int64)
            fps = np.frombuffer(b"".join(b.column(b.num_columns - 1).to_pylist()), "<u8").reshape(b.num_rows, WIDE // 64)
            if carry is not None:
                numbers, fps = np.concatenate([carry[0], numbers]), np.concatenate([carry[1], fps])
            if not len(numbers):
                continue
            new = np.flatnonzero(np.any(numbers[1:, :n_keys] != numbers[:-1, :n_keys], axis=1)) + 1
            end = int(new[-1]) if len(new) else 0
            carry = numbers[end:], fps[end:]
            if end:
                yield numbers[:end, :n_keys], numbers[:end, n_keys:], fps[:end], np.concatenate([[0], new])
        elif carry is not None:
            yield carry[0][:, :n_keys], carry[0][:, n_keys:], carry[1], np.array([0, len(carry[1])])


def _three(u: list, v: list, k: list) -> pa.RecordBatch:
    joined = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64)) for x in (u, v, k)]
    return pa.RecordBatch.from_arrays(joined, names=["u", "v", "k"])


def _candidates(near: int, distance: int, similarity: float):
    """Sorted rows of (t, k, i, j, node, at, n, fp) to (u, v, 0), pairs that may be similar: all of a small group within
    `distance`; of a large one a spanning forest within `near`, and (node, -1 - at, k) for its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, numbers, fps, bounds in _sorted_groups(batches):
            sizes, (names, at, n), u, v, k = np.diff(bounds), numbers.T, [], [], []

            def good(x: np.ndarray, y: np.ndarray, n=n, at=at) -> np.ndarray:
                return may_reach(n[x], at[x], n[y], at[y], similarity)

            two = bounds[:-1][sizes == 2]
            two = two[good(two, two + 1)]
            two = two[differing(fps[two], fps[two + 1]) <= distance]
            u.append(names[two])
            v.append(names[two + 1])
            k.append(np.zeros(len(two), np.int64))
            for s, m in zip(bounds[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if m <= SMALL:
                    x, y = np.nonzero(np.triu(differing(fps[s : s + m, None], fps[None, s : s + m]) <= distance, 1))
                else:
                    x = cluster(fps[s : s + m], near)
                    y = np.flatnonzero(x != np.arange(m))
                    x = x[y]
                    u.append(names[s : s + m])
                    v.append(-1 - at[s : s + m])
                    k.append(np.full(m, keys[s, 1]))
                x, y = x + s, y + s
                ok = good(x, y)
                u.append(names[x[ok]])
                v.append(names[y[ok]])
                k.append(np.zeros(int(ok.sum()), np.int64))
            yield _three(u, v, k)

    return run


def _apart(distance: int, similarity: float, nearest: bool):
    """Sorted rows of (t, k, i, j, node, root, at, n, fp) to pairs (u, v, 0) of different roots that may be similar: all of
    them, or for each row that of the fewest differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, numbers, fps, bounds in _sorted_groups(batches):
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                nodes, roots, at, n = numbers[s:e].T
                u, v = [], []
                if (roots != roots[0]).any():
                    for a in range(e - s):
                        rest = slice(0 if nearest else a + 1, None)
                        other = np.flatnonzero((roots[rest] != roots[a]) & may_reach(n[rest], at[rest], n[a], at[a], similarity)) + rest.start
                        bits = differing(fps[s:e][other], fps[s + a])
                        other = other[bits <= distance]
                        if nearest and len(other):
                            other = other[[bits[bits <= distance].argmin()]]
                        u.append(np.full(len(other), nodes[a]))
                        v.append(nodes[other])
                yield _three(u, v, [np.zeros(len(x), np.int64) for x in u])

    return run


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, z = ([np.frombuffer(x, np.uint64) for x in b.column(i).to_pylist()] for i in (2, 3))
            good = pa.array([similar(x, y, similarity) for x, y in zip(a, z, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], names=["u", "v"])

    return run


def _hash_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_hashes(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "h"])


def _similar_pairs(pairs: DataFrame, sets: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (u, v), a written table, whose texts' shingles are as similar as that, compared in full; the shingles
    are removed."""
    before = made()
    small_batches(rows.sparkSession)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ends = materialise(ends.join(sets.select("node", "body"), "node").select("node", "body"), "wide-ends")
    if ends.count() <= BROADCAST_ENDS:
        ends = F.broadcast(ends)
    bodies = rows.select("body", "text").join(ends, "body").dropDuplicates(["node"]).select("node", "text")
    hashes = materialise(bodies.mapInArrow(handing_back(_hash_sets), "node long, h binary"), "wide-sets")
    first = materialise(spread_join(pairs.select("u", "v"), hashes.toDF("u", "a"), ["u"]), "wide-firsts")
    both = spread_join(first, hashes.toDF("v", "z"), ["v"]).select("u", "v", "a", "z")
    links = materialise(both.mapInArrow(handing_back(_verified(similarity)), "u long, v long"), LINKS)
    remove(pairs.sparkSession, [f for f in made() if f not in before and not f.endswith(LINKS)])
    return links


def _rooted_apart(large: DataFrame, roots: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows (node, k, at) of large whose key has several roots, with t, root, n and fp."""
    rooted = materialise(large.join(roots, "node", "left").select("node", "k", "at", F.coalesce("root", "node").alias("root")), "wide-large")
    several = rooted.groupBy("k").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a != z").select("k")
    apart = spread_join(rooted, several, ["k"]).join(sets.select("node", "n", "fp"), "node")
    return materialise(apart.select("node", "root", "at", "n", F.lit(0).alias("t"), "k", "fp"), "wide-apart")


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY, group: int = GROUP) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest identifier reachable, itself included), by links
    between texts whose five-word shingles have a Jaccard similarity of `similarity` or more.

    64-bit fingerprints of such texts differ by ten bits and more, too many for blocks, so these have WIDE bits of the set
    of shingles, and meet under shingles: of each set the first prefix_length() ones in an order that puts common ones
    last are its keys, and two sets of the similarity share one for certain. Pairs that share a key and differ by no more
    bits than the similarity explains, with DEVIATIONS to spare, are candidates, unless what follows the key in their
    order is too little for the similarity; each is verified on all shingles. In groups over SMALL a
    spanning forest of close fingerprints goes first, then for ROUNDS rounds each set's nearest candidate among those that
    the verified links leave apart, and then all candidates still apart, so that a large group of copies costs no square
    of pairs. Equal sets of shingles collapse first;
    keys with very many sets are compared in chunks, as in links(). Null and empty texts are linked to each other, texts
    under five words are one shingle. Null or repeated identifiers as in near_groups(); other columns don't matter.
    """
    return _similar_members(docs, text, doc_id, similarity, group).select("doc_id", "component_id")


def _similar_members(docs: DataFrame, text: str, doc_id: str, similarity: float, group: int) -> DataFrame:
    """similar_groups with body, the hash of the row's text, and root, a number of the component."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), _body(text).alias("body"), F.col(text).cast("string").alias("text"))
    common = _common_shingles(rows)
    prints = materialise(rows.mapInArrow(handing_back(_wide_prints(common, similarity)), "doc_id long, body string, sid binary, fp binary, prefix binary, n long"), "wide-prints")
    sets = prints.groupBy("sid").agg(F.min("doc_id").alias("least"), F.min("body").alias("body"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("n").alias("n"))
    sets = materialise(sets.withColumn("node", F.monotonically_increasing_id()), "wide-fps")
    nodes = sets.select("node", "n", "fp", "prefix")
    keys, counted = nodes.mapInArrow(handing_back(_prefix_keys(True)), "node long, at long, n long, fp binary, t int, k long"), nodes.mapInArrow(handing_back(_prefix_keys(False)), "t int, k long")
    n_keys = sets.agg(F.sum(F.length("prefix"))).first()[0] or 0
    distance = wide_distance(similarity, DEVIATIONS, TIED_SHARE if similarity >= SIMILARITY else 0.0)
    found = _dealt(keys, counted, ["node", "at", "n", "fp"], n_keys // 8, group).select("t", "k", "i", "j", "node", "at", "n", "fp")
    found = materialise(found.mapInArrow(handing_back(_candidates(wide_distance(similarity), distance, similarity)), "u long, v long, k long").distinct(), "wide-candidates")
    pairs = found.where("v >= 0").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges = _similar_pairs(materialise(pairs, "wide-pairs"), sets, rows, similarity)
    large = found.where("v < 0").select(F.col("u").alias("node"), "k", (-1 - F.col("v")).alias("at"))
    roots = components(edges)
    nearest, rounds = True, 0
    while rounds or not large.isEmpty():
        before = made()
        apart = _rooted_apart(large, roots, sets)
        if apart.isEmpty():
            break
        dealt = _dealt(apart, apart, ["node", "root", "at", "n", "fp"], apart.count(), group).select("t", "k", "i", "j", "node", "root", "at", "n", "fp")
        more = dealt.mapInArrow(handing_back(_apart(distance, similarity, nearest)), "u long, v long, k long")
        more = more.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        more = materialise(more, "wide-more")
        linked = _similar_pairs(more, sets, rows, similarity)
        fruitful = linked.count() >= FRUITFUL * more.count()
        remove(spark, [f for f in made() if f not in before and not f.endswith(LINKS)])
        roots = components(roots.toDF("u", "v").unionByName(linked))
        if not nearest:
            break
        rounds += 1
        nearest = fruitful and rounds < ROUNDS
    known = materialise(sets.join(roots, "node", "left").select("sid", "least", F.coalesce("root", "node").alias("root")), "wide-roots")
    first = known.groupBy("root").agg(F.min("least").alias("component_id"))
    members = materialise(spread_join(known, first, ["root"]).select("sid", "root", "component_id"), "wide-members")
    return spread_join(prints.select("doc_id", "body", "sid"), members, ["sid"]).select("doc_id", "body", "root", "component_id")


def _body(text: str) -> Column:
    return F.md5(whole(text).cast("string"))


def drop_near(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of similar texts, that of its smallest identifier, or of the smaller hash where
    texts share that; null identifiers come last. Columns as they are."""
    rows = materialise(_similar_members(docs, text, doc_id, similarity, GROUP).select("doc_id", "body", "root"), "wide-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    kept = rows.groupBy("root").agg(F.min(order).alias("kept"))
    lost = spread_join(rows, kept, ["root"]).where(~order.eqNullSafe(F.col("kept"))).select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "body").alias("row_key"))
    left = keyed_rows(docs, text, doc_id).join(lost.distinct(), "row_key", "left_anti")
    return unkeyed_rows(left.dropDuplicates(["row_key"]), docs.columns)
