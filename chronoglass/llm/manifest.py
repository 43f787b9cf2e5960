"""Merkle dataset manifest: sorted leaf runs, a node store of level-partitioned Parquet, proofs by merge-scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, new_folder

#: Levels that one pass over the store builds. A block is the 2**BAND nodes that share an ancestor BAND levels up.
BAND = 8
#: The columns a leaf hashes, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOTS = ""  # the key of the tree over all trees' roots


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 length in bytes, `:` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return digest(*map(field, values))


def tree_key(value: Column) -> Column:
    """Keys in the order of the values' bytes, null first, and never null."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def _runs(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, h, ...) in sorted runs, written, with n, the leaves of their tree, and idx, the place among them.

    Runs are range partitions by tree and order, so a tree's leaves may lie in any number of them. Each run counts its
    leaves by tree; a tree's counts are prefix-summed over the runs, of which there are as many as partitions.
    """
    rows = leaves.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")
    rows = materialise(rows.withColumn("at", F.monotonically_increasing_id()), "leaf-runs")
    run = F.shiftright("at", 33)
    counts = rows.groupBy("tree", run.alias("run")).agg(F.min("at").alias("first"), F.count("*").alias("run_n"))
    by_tree = Window.partitionBy("tree")
    base = F.sum("run_n").over(by_tree.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("tree", "run", (F.coalesce(base, F.lit(0)) - F.col("first")).alias("shift"), F.sum("run_n").over(by_tree).alias("n"))
    return rows.withColumn("run", run).join(counts, ["tree", "run"]).withColumn("idx", F.col("at") + F.col("shift")).drop("at", "run", "shift")


def _levels(band: int) -> Column:
    """The levels that nodes `hs` of a block give, from themselves up to `up` levels more: each reads the one before."""

    def above(level: Column) -> Column:
        half = F.sequence(F.lit(0), F.shiftright(F.size(level) - 1, 1))
        return F.transform(half, lambda i: digest(F.get(level, i * 2), F.coalesce(F.get(level, i * 2 + 1), F.lit(""))))

    steps = F.filter(F.sequence(F.lit(1), F.lit(band)), lambda k: k <= F.col("up"))
    return F.aggregate(steps, F.array("hs"), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))


def _halvings(n: Column, most: int) -> Column:
    """How often n nodes halve, rounded up, until one is left; most at most. The sizes are integers, so no logarithm errs."""
    return sum((F.when(n > 1 << k, 1).otherwise(0) for k in range(most)), F.lit(0))


class NodeStore:
    """A manifest's nodes, as Parquet that is partitioned by level.

    A row is (level, tree, n, idx, h, payload): the node idx of its level in a tree of n leaves, its digest, and at level
    0 what was carried along. Levels come in bands: one pass reads the last level there is in blocks, range-partitioned
    and sorted by tree and block, derives each level of a block from the one below, and writes the nodes of each level to
    that level's partition. A block has 2**band nodes, whatever the tree's size, so a task holds one block and its levels.
    """

    def __init__(self, spark: SparkSession, folder: str, payload: str, band: int = BAND):
        self.spark, self.folder, self.band, self.bands = spark, folder, band, 0
        self.kinds = f"tree string, n long, idx long, h string, payload {payload}, level int"

    def nodes(self, low: int, high: int) -> DataFrame:
        """Nodes of levels low up to high, of which those that hold no row are none."""
        return self.spark.read.schema(self.kinds).parquet(self.folder).where(F.col("level").between(low, high))

    def _append(self, nodes: DataFrame) -> None:
        nodes.write.mode("append").partitionBy("level").parquet(self.folder)

    def blocks(self, k: int) -> DataFrame:
        """Band k's blocks: (tree, n, block, hs, payloads, up), of trees that have more than one node there or, in band 0,
        any: the digests in order, and the levels that the block's tree has within this band."""
        at = self.band * k
        width = F.floor((F.col("n") + F.lit((1 << at) - 1)) / F.lit(1 << at)).cast("long")
        rows = self.nodes(at, at).withColumn("width", width).where((F.col("width") > 1) | F.lit(k == 0)).withColumn("block", F.shiftright("idx", self.band))
        rows = rows.repartitionByRange("tree", "block").groupBy("tree", "block")
        rows = rows.agg(F.first("n").alias("n"), F.first("width").alias("width"), F.sort_array(F.collect_list(F.struct("idx", "h", "payload"))).alias("row"))
        return rows.select("tree", "block", "n", F.col("row.h").alias("hs"), F.col("row.payload").alias("payloads"), _halvings(F.col("width"), self.band).alias("up"))

    def build(self, leaves: DataFrame) -> NodeStore:
        """Writes leaves (tree, n, idx, h, payload), then band after band until every tree has its root."""
        self._append(leaves.select("tree", "n", "idx", "h", "payload", F.lit(0).alias("level")))
        largest = self.nodes(0, 0).agg(F.max("n")).first()[0] or 0
        while self.bands == 0 or largest > 1 << self.band * self.bands:
            k = self.bands
            found = self.blocks(k).select("tree", "n", "block", "up", F.posexplode(_levels(self.band)).alias("l", "level_h")).where("l > 0")
            found = found.select("tree", "n", "block", "up", "l", F.posexplode("level_h").alias("i", "h"))
            idx = F.expr(f"shiftleft(block, {self.band} - l)") + F.col("i")
            self._append(found.select("tree", "n", idx.alias("idx"), "h", F.lit(None).cast(self.nodes(0, 0).schema["payload"].dataType).alias("payload"), (F.col("l") + F.lit(self.band * k)).cast("int").alias("level")))
            self.bands += 1
        return self

    def roots(self) -> DataFrame:
        """(tree, h), a row per tree."""
        top = _halvings(F.col("n"), self.band * self.bands)
        return self.nodes(0, self.band * self.bands).where(F.col("level") == top).select("tree", "h")

    def _scanned(self, k: int) -> DataFrame:
        """Band k's blocks with `levels`, read from the store by coordinate: an ancestor at any level within the band has
        its block's number in the high bits of its own, so one sorted scan over the levels meets blocks whole."""
        at, kept = self.band * k, self.band - (F.col("level") - F.lit(self.band * k))
        rows = self.nodes(at, at + self.band - 1).where((F.col("n") > 1 << at) | F.lit(k == 0))
        rows = rows.withColumn("block", F.call_function("shiftright", "idx", kept.cast("int"))).repartitionByRange("tree", "block").groupBy("tree", "block")
        rows = rows.agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("level", "idx", "h", "payload"))).alias("row"))
        levels = F.transform(F.sequence(F.lit(at), F.lit(at + self.band - 1)), lambda l: F.transform(F.filter("row", lambda x: x["level"] == l), lambda x: x["h"]))
        payloads = F.transform(F.filter("row", lambda x: x["level"] == at), lambda x: x["payload"])
        width = F.floor((F.col("n") + F.lit((1 << at) - 1)) / F.lit(1 << at)).cast("long")
        return rows.select("tree", "block", "n", levels.alias("levels"), payloads.alias("payloads"), _halvings(width, self.band).alias("up"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """(tree, idx, h, payload, path, + columns of above) per leaf. above: (tree, path, ...) a row per tree, what
        stands over its root.

        path is an array of (sibling, left) from the leaf up, of which sibling is null where the run had one node. Bands
        are met from the top down: what stands over a block is found once and joined by its coordinate, to the block and
        not to its nodes, and a block's node then adds its siblings within the block.
        """
        more = [c for c in above.columns if c not in ("tree", "path")]
        over = above.select("tree", F.lit(0).cast("long").alias("block"), "path", *more)
        met = None
        for k in reversed(range(self.bands)):
            blocks = self._scanned(k)
            # trees whose root is the end of this band start here; the others' blocks hang below the band above
            here = F.col("n") <= F.lit(1 << self.band * (k + 1))
            tops = blocks.where(here).join(over, ["tree", "block"])
            found = tops if met is None else tops.unionByName(blocks.where(~here).join(met, ["tree", "block"]))
            low = F.sequence(F.lit(0), F.size(F.get("levels", F.lit(0))) - 1)
            found = found.withColumn("place", F.explode(low))

            def sibling(l: Column) -> Column:
                at = F.call_function("shiftright", "place", l)
                return F.struct(F.get(F.get("levels", l), at.bitwiseXOR(F.lit(1))).alias("sibling"), (at.bitwiseAND(F.lit(1)) == 1).alias("left"))

            steps = F.filter(F.sequence(F.lit(0), F.lit(self.band - 1)), lambda l: l < F.col("up"))
            path = F.concat(F.transform(steps, sibling), "path")
            idx = F.shiftleft("block", self.band) + F.col("place")
            hs, payload = F.get(F.get("levels", F.lit(0)), "place"), F.get("payloads", "place")
            met = found.select("tree", idx.alias("block"), hs.alias("h"), payload.alias("payload"), path.alias("path"), *more)
            if k:
                met = met.drop("h", "payload")
        return met.withColumnRenamed("block", "idx")


def fold(h: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, h, lambda got, x: F.sha2(F.when(x["left"], F.concat(x["sibling"], got)).otherwise(F.concat(got, F.coalesce(x["sibling"], F.lit("")))), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: x["sibling"]), ""), 256)


def manifest(rows: DataFrame, order: list[str], band: int = BAND) -> DataFrame:
    """Per row of rows (tree, h, payload, and the order's columns): tree, idx, h, payload, path, subroot, root.

    One tree per key, over its rows in the given order; ties go by digest. The trees' roots, ordered by key, are the
    leaves of one more tree, of the same kind. Every two consecutive nodes of a level become one, the last alone if their
    number is odd, until one is left; one leaf alone is its tree's root. An empty table has no tree and gives no row.
    """
    spark = rows.sparkSession
    payload = rows.schema["payload"].dataType.simpleString()
    trees = NodeStore(spark, new_folder(spark, "nodes"), payload, band).build(_runs(rows, [*order, "h"]))
    tops = trees.roots().select(F.lit(ROOTS).alias("tree"), "h", F.col("tree").alias("payload"))
    top = NodeStore(spark, new_folder(spark, "root-nodes"), "string", band).build(_runs(tops, ["payload"]))
    root = top.roots().select("tree", F.expr("cast(array() as array<struct<sibling: string, left: boolean>>)").alias("path"), F.col("h").alias("root"))
    over = top.proofs(root).select(F.col("payload").alias("tree"), "path", F.col("h").alias("subroot"), "root")
    return trees.proofs(over)


def document_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, lang: str = "lang", doc_id: str = "doc_id", altered: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of docs, a row per row: doc_id, leaf, subroot, root, path, and other_leaf, the digest of the row with
    some columns replaced by `altered`, equal to leaf where nothing changes.

    A leaf is the digest of its fields; leaves of a language (null: one of its own, before all others) ascend by doc_id,
    null first, rows of one identifier by digest. Texts are hashed where they are read; digests alone are shuffled.
    Repeated rows are leaves each. Null or empty texts are fields like any other.
    """
    values = {c: F.col(c) for c in fields}
    changed = values | (altered or {})
    rows = docs.select(tree_key(F.col(lang)).alias("tree"), F.col(doc_id).alias("doc_id"), leaf_hash(*values.values()).alias("h"), leaf_hash(*changed.values()).alias("other"))
    rows = rows.select("tree", "doc_id", "h", F.struct("doc_id", "other").alias("payload"))
    found = manifest(rows, ["doc_id"])
    return found.select(F.col("payload.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root", "path", F.col("payload.other").alias("other_leaf"))
