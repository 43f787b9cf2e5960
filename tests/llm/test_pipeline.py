"""The pipeline's stages, each against brute force on its own input."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P
from chronoglass.llm.tokens import Encoder, public

from .test_corpus import jaccard, low, shingles


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit(1)).withColumn("fp", F.lit("x"))
    extra = [(10_000, None, "en"), (10_001, "12 34 !", "en"), (10_002, "hello hello world", None), (10_003, "hello hello world", "en"), (10_004, "HELLO hello world", "en")]
    more = spark.createDataFrame([(i, t, k, None, None, 1, "x") for i, t, k in extra], docs.schema)
    docs = docs.unionByName(more)
    seen = {}
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(P.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen[name] = (rows(docs) if "text" in docs.columns else None, out := spark.read.parquet(str(tmp_path / name)))
        docs = out

    before, out = seen["language_id"]
    assert sorted(rows(out)) == sorted((i, t) for i, t in before if any(c.isalpha() for c in t or ""))
    assert out.where("lang IS NULL").count() == 0

    before, out = seen["exact_dedup"]
    last = {}
    for i, t in before:
        last[low(t)] = max(i, last.get(low(t), i))
    assert sorted(i for i, _ in rows(out)) == sorted(last.values())

    before, out = seen["simhash_near_dedup"]
    kept, sets = {i for i, _ in rows(out)}, {i: shingles(t) for i, t in before}
    best = {i: max((jaccard(s, o) for k, o in sets.items() if k < i), default=0.0) for i, s in sets.items()}
    near = {i: min([i, *(k for k, o in sets.items() if k < i and jaccard(s, o) >= 0.8)]) for i, s in sets.items()}
    for _ in range(50):  # components' smallest identifiers
        near = {i: near[k] for i, k in near.items()}
    assert kept <= set(sets) and {i for i in sets if best[i] < 0.8} <= kept
    assert not kept & {i for i in sets if best[i] >= 0.8 and near[i] != i}

    before, out = seen["decontamination"]
    bench = [" ".join(r.text.split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    holds = {i for i, t in before if any(b in " ".join(t.split()) for b in bench)}
    left = {i for i, _ in rows(out)}
    assert holds and not holds & left and len(before) - len(left) <= 2 * len(holds) + 3

    before, out = seen["packing"]
    tok = Encoder(public("word_bpe_49k.json")).tok
    n = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in before}
    got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id: r.n for r in got} == n == {r.doc_id: r["all"] for r in got}
    at = np.array(sorted((r.sequence_id * 4096 + r.offset, r.length) for r in out.collect()))
    assert (at[:, 0] == np.concatenate([[0], np.cumsum(at[:, 1])[:-1]])).all()


def test_stages_on_nothing_and_on_unknown_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    unknown = docs.limit(30).withColumn("lang", F.lit(None).cast("string")).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    for table, n in ((docs.limit(0), 0), (unknown, 30)):
        for name, stage in P.STAGES:
            out = stage(spark, table, sf_dir)
            assert out.count() == (n if name == "language_id" else out.count()) and (n or out.count() == 0), name


def test_run_equals_stages(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.agg(F.sum("length")).first()[0] > 0 and out.columns[0] == "doc_id"
