"""Exact dedup by content sort: sampled splitters, external sort, full comparison of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialise, whole

#: Bytes of a text that splitters hold before its 64-bit hash.
HEAD = 32
#: Copies of one text that are sorted in one place; a text with more, or with over a millionth of all rows, is split.
HOT_ROWS = 1000


def _norm(text: str) -> Column:
    return ascii_lower(whole(text))


def _sort_keys(docs: DataFrame, text: str, hot_rows: int) -> DataFrame:
    """docs with head, h and salt: what splitters are made of, and which part of a hot text a row is in.

    Only texts that a count over all rows proves hot have salts but 0. They are under a million whatever the data, as
    each has over a millionth of the rows; their hashes are broadcast. The salt comes from the row's place in the input,
    so copies that share an identifier are dealt out too.
    """
    keyed = docs.withColumn("__head", F.substring(_norm(text).cast("binary"), 1, HEAD)).withColumn("__h", F.xxhash64(_norm(text)))
    counts = docs.select(F.xxhash64(_norm(text)).alias("__h")).groupBy("__h").agg(F.count("*").alias("__n"))
    counts = materialise(counts.where(F.col("__n") > hot_rows), "hot-texts")
    limit = max(hot_rows, (counts.agg(F.sum("__n")).first()[0] or 0) // 1_000_000)
    hot = counts.where(F.col("__n") > limit).select("__h", F.ceil(F.col("__n") / limit).alias("__parts"))
    keyed = keyed.join(F.broadcast(hot), "__h", "left")
    salt = F.when(F.col("__parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__parts")))
    return keyed.withColumn("__salt", salt.cast("int")).withColumn("__hot", F.col("__parts").isNotNull()).drop("__parts")


def _order(doc_id: str, last: bool) -> Column:
    return F.col(doc_id).asc_nulls_first() if last else F.col(doc_id).desc_nulls_first()


def _sorted(keyed: DataFrame, text: str, doc_id: str, last: bool) -> DataFrame:
    """Rows with their sort keys, range-partitioned and sorted by content, with __last, whether no equal text follows, and
    __run, the number of its run of equal neighbours in (head, h, salt)."""
    rows = keyed.repartitionByRange("__head", "__h", "__salt")
    return _compare(rows.withColumn("__norm", _norm(text)), ["__head", "__h", "__salt"], _order(doc_id, last)).drop("__norm")


def _compare(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Sorts by keys, then by the whole of __norm, then by order; each row is compared in full with its neighbours."""
    w = Window.partitionBy(*keys).orderBy("__norm", order)
    rows = rows.withColumn("__first", (~F.lag("__norm").over(w).eqNullSafe(F.col("__norm"))).cast("int")).withColumn("__last", ~F.lead("__norm").over(w).eqNullSafe(F.col("__norm")))
    return rows.withColumn("__run", F.sum("__first").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are range-partitioned by sampled splitters on the first bytes of the normalised text and its 64-bit hash: a
    bounded key, so that sampling never moves texts, and one under which equal texts are neighbours and no splitter can
    part them. Spark's external sort orders each partition by that and then the whole text, and each row is compared in
    full with its neighbours; a run of equal ones is a group. The hash only orders; equality is decided by the texts.

    A text with over `hot_rows` copies is dealt out into several runs. The first text of each of its runs, so a bounded
    number of them, is sorted and compared again, and what is counted in the runs is joined.

    Null texts count as empty ones and are a group of their own like any other. Of rows that share identifier and text,
    one is kept. A group whose identifiers are all null keeps one row; its keep_id is null. Other columns don't matter.
    keep: "largest" or "smallest" identifier stays.
    """
    last, best = keep == "largest", F.max if keep == "largest" else F.min
    rows = _sorted(_sort_keys(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", hot_rows), "text", "doc_id", last)
    rows = rows.withColumn("__rep", F.when(F.col("__hot") & (F.col("__first") == 1), F.col("text"))).withColumn("text_sha256", F.sha2(_norm("text"), 256)).drop("text")
    run = Window.partitionBy("__head", "__h", "__salt", "__run")
    rows = rows.withColumn("keep_id", best("doc_id").over(run)).withColumn("group_size", F.count("*").over(run))
    rows = materialise(rows.withColumn("kept", F.col("__last")), "sorted")
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    cold = rows.where(~F.col("__hot")).select(*out)

    firsts = rows.where("__hot AND __first = 1").select("__head", "__h", "__salt", "__run", "keep_id", "group_size", F.coalesce(_norm("__rep"), F.lit("")).alias("__norm"))
    firsts = _compare(firsts.withColumnRenamed("__run", "__part"), ["__head", "__h"], F.col("__salt").asc())
    group = Window.partitionBy("__head", "__h", "__run")
    ahead = F.struct(F.coalesce(F.col("keep_id"), F.lit(0)) * (1 if last else -1), F.col("__salt"))
    firsts = firsts.select(
        "__head", "__h", "__salt", F.col("__part").alias("__run"), best("keep_id").over(group).alias("of_all"), F.sum("group_size").over(group).alias("n"),
        (F.max(F.struct(F.col("keep_id").isNotNull(), ahead)).over(group) == F.struct(F.col("keep_id").isNotNull(), ahead)).alias("__keeps"),
    )
    hot = rows.where("__hot").join(F.broadcast(materialise(firsts, "hot-runs")), ["__head", "__h", "__salt", "__run"])
    hot = hot.select("doc_id", F.col("of_all").alias("keep_id"), F.col("n").alias("group_size"), (F.col("kept") & F.col("__keeps")).alias("kept"), "text_sha256")
    return cold.unionByName(hot)


def drop_exact(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "largest", hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs without all but one row of each group of equal texts; columns as they are. Rows go through one content sort
    with all their columns, and the survivors of a hot text's runs, which alone are written, through another."""
    columns, last = docs.columns, keep == "largest"
    numbered = docs.toDF(*(f"c{i}" for i in range(len(columns))))  # so that no column's name clashes
    t, d = f"c{columns.index(text)}", f"c{columns.index(doc_id)}"
    keyed = _sort_keys(numbered, t, hot_rows)
    cold = _sorted(keyed.where(~F.col("__hot")), t, d, last).where("__last").select(*numbered.columns)
    runs = _sorted(keyed.where("__hot"), t, d, last).where("__last").select(*numbered.columns, "__head", "__h")
    hot = _compare(materialise(runs, "hot-runs").withColumn("__norm", _norm(t)), ["__head", "__h"], _order(d, last)).where("__last")
    return cold.unionByName(hot.select(*numbered.columns)).toDF(*columns)
