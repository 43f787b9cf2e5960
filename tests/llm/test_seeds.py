"""Seeds that many items share, and drops that leave their callers' columns alone."""

import random

import pytest

from chronoglass.llm import decontam, simhash
from chronoglass.llm.decontam import LADDER, SEED_ITEMS

RNG = random.Random(3)


def words(n, tag):
    return " ".join(f"{tag}{RNG.randrange(10**9)}" for _ in range(n))


def test_common_words_bring_nobody_together(spark):
    items = [(i, f"{words(4, 'a')} one of the {words(6, 'b')}") for i in range(400)]
    docs = [(i, f"{words(30, 'c')} one of the {words(30, 'd')}") for i in range(400)]
    docs += [(1000 + i, f"{words(5, 'e')} {items[i][1]} {words(5, 'f')}") for i in range(5)]  # copies
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    out = decontam.contaminated(table, bench)
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    assert got == {(1000 + i, i) for i in range(5)}
    grams = bench.selectExpr("item_id AS ino", "text").rdd.map(lambda r: (r.ino, decontam.word_hashes(r.text).tobytes())).toDF("ino long, item binary")
    seeds = decontam.rare_seeds(grams.mapInArrow(decontam._seeds_of_items, "ino long, code long, q long, width long, step long, last boolean"))
    shared = seeds.groupBy("code").count().where(f"count > {SEED_ITEMS}").count()
    assert shared == 0 and {r.width for r in seeds.select("width").distinct().collect()} == {3, 5}


def test_the_ladder_ends_with_the_whole_item(spark):
    same = words(4, "x")
    items = [(i, same) for i in range(SEED_ITEMS + 5)] + [(100 + i, f"{same} {words(2, 'y')} {same}") for i in range(SEED_ITEMS + 5)] + [(200, words(40, "z"))]
    run = items[-1][1].split(" ")
    docs = [(1, f"{words(9, 'q')} {same} {words(9, 'r')}"), (2, items[30][1]), (3, " ".join([*run[5:18], words(30, "s")])), (4, " ".join(run[7:9])), (5, None), (6, "")]
    out = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    short = set(range(SEED_ITEMS + 5))
    assert {i for d, i in got if d == 1 and i < 100} == short and {i for d, i in got if d == 2 and i < 100} == short
    assert (2, items[30][0]) in got and (3, 200) in got and not {d for d, _ in got} & {4, 5, 6}
    assert LADDER[-1] == decontam.LEAK_WORDS


@pytest.mark.parametrize("name", ["row_key", "__row_key", "row", "c0", "key"])
def test_columns_stay(spark, name):
    text = words(40, "w")
    docs = spark.createDataFrame([(1, text, "kept"), (2, text, "gone"), (3, words(40, "v"), None), (None, None, "none")], f"doc_id long, text string, {name} string")
    near = simhash.drop_near(docs)
    assert near.columns == docs.columns and sorted(map(repr, near.collect())) == sorted(map(repr, docs.where("doc_id IS NULL OR doc_id != 2").collect()))
    bench = spark.createDataFrame([(7, text)], "item_id long, text string")
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(map(repr, left.collect())) == sorted(map(repr, docs.where("doc_id IS NULL OR doc_id = 3").collect()))
