"""The Merkle manifest against a tree that is built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from chronoglass.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, h string, payload string, level int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root, and each leaf's (sibling, left) by level."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            j = i ^ 1
            paths[k].append((level[j] if j < len(level) else None, i % 2 == 1))
        level, at = [H(*level[i : i + 2]) for i in range(0, len(level), 2)], [i // 2 for i in at]
    return level[0], paths


def fold(h, path):
    for sibling, left in path:
        h = H(sibling, h) if left else H(h, sibling or "")
    return h


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    by = {k: sorted((r for r in rows if r[2] == k), key=lambda r: (r[0] is not None, r[0] or 0, H(*map(field, r)))) for k in langs}
    trees = {k: tree([H(*map(field, r)) for r in v]) for k, v in by.items()}
    root, tops = tree([trees[k][0] for k in langs])
    out = []
    for k, top in zip(langs, tops, strict=True):
        for r, path in zip(by[k], trees[k][1], strict=True):
            path = path + top
            other = H(*map(field, (*r[:3], r[3] + 1 if r[3] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else r[3], r[4])))
            got = fold(other, path)
            out.append((r[0], H(*map(field, r)), trees[k][0], root, H("".join(s for s, _ in path if s)), got, got == root))
    return sorted(out, key=repr)


def ours(df, **how):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest.document_manifest(df, altered={"n_chars": tampered}, **how)
    out = out.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")), manifest.fold(F.col("other_leaf"), F.col("path")))
    return sorted(((*r, r[5] == r[3]) for r in out.collect()), key=repr)


def rows_of(n, langs):
    return [(i, f"src{i % 3}" if i % 5 else None, langs[i % len(langs)], i * 7 if i % 4 else None, "é text\n" * (i % 9) if i % 6 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "band"), [(1, 8), (5, 1), (41, 2), (300, 3)])
def test_against_memory(spark, monkeypatch, n, band):
    monkeypatch.setattr(manifest.manifest, "__defaults__", (band,))
    rows = rows_of(n, ["en", None, "é", "en", "", "de", "en"])
    rows += [(3, "s", "en", 1, "same"), (3, "s", "en", 1, "same"), (None, None, None, None, None), (None, None, "en", 5, ""), (7, "s", "only", 3, "x" * 50_000)]
    df = spark.createDataFrame([(*r, "t", "h", "p", 1) for r in rows], SCHEMA).repartition(5)
    assert ours(df) == brute(rows)


def test_empty_and_single(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ours(df) == []
    rows = [(5, "a", "en", 1, "x")]
    assert ours(spark.createDataFrame([(*r, "t", "h", "p", 1) for r in rows], SCHEMA)) == brute(rows)
    assert ours(spark.createDataFrame([(*r, "t", "h", "p", 1) for r in rows], SCHEMA))[0][4] == hashlib.sha256(b"").hexdigest()


def test_one_hot_language_and_many(spark):
    rows = rows_of(700, ["en"]) + [(i, "s", f"l{i}", i, "t") for i in range(1000, 1200)]
    df = spark.createDataFrame([(*r, "t", "h", "p", 1) for r in rows], SCHEMA).repartition(7)
    assert ours(df) == brute(rows)


def test_store_is_partitioned_by_level(spark, tmp_path):
    rows = [("", "%064x" % i, i) for i in range(37)]
    leaves = manifest._runs(spark.createDataFrame(rows, "tree string, h string, payload long"), ["payload"])
    store = manifest.NodeStore(spark, str(tmp_path / "store"), "bigint", 2).build(leaves)
    assert [r[1] for r in store.nodes(0, 9).groupBy("level").count().orderBy("level").collect()] == [37, 19, 10, 5, 3, 2, 1]
    assert sorted(p.name for p in (tmp_path / "store").glob("level=*")) == [f"level={k}" for k in range(7)]
    assert store.roots().collect()[0].h == tree([r[1] for r in rows])[0]
