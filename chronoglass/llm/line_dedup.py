"""Line dedup with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, materialise, new_folder, spread_join, whole

MIN_CHARS, MIN_DOCS, FANOUT = 20, 3, 2
#: Batches at least, and lines of a batch; buckets of a run at least, and lines of a bucket.
BATCHES, BATCH_LINES, BUCKETS, BUCKET_LINES = 3, 2_000_000_000, 16, 20_000_000
HASHES = ["h1", "h2"]
#: A scan of a bucket that is one sorted file is taken as sorted.
SORTED_SCAN = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def key_hash(key: Column) -> Column:
    """128 bits: at 64, among the lines of a large corpus, different ones would collide."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t1, t2, at, h1, h2) of (doc_id, text): each long line, its place, and a hash of its text."""
    split = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2"), F.posexplode(F.split(whole("text"), "\n", -1)).alias("at", "line"))
    keyed = split.select("doc_id", "t1", "t2", "at", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select("doc_id", "t1", "t2", "at", key_hash(F.col("key")).alias("h")).select("doc_id", "t1", "t2", "at", "h.h1", "h.h2")


@contextmanager
def _sorted_scans(spark: SparkSession):
    before = spark.conf.get(SORTED_SCAN, "false")
    spark.conf.set(SORTED_SCAN, "true")
    try:
        yield
    finally:
        spark.conf.set(SORTED_SCAN, before)


class LineRuns:
    """Runs of (h1, h2, n_docs, top), bucketed and sorted by hash, in levels.

    add() merge-anti-joins a batch with all runs. Keys that none has are fresh: the batch's run opens them with their
    number of documents and the largest identifier. Keys that were met before only add to the number; their top stays
    null, so that the document that opened a key is the one that keeps it, and batches should come with the largest
    identifiers first. The batch's run goes to level 0; a level with `fanout` runs is merged into one of the next.
    Batches must not share documents. Each key is pre-aggregated before a batch is shuffled, so a hot line is one row
    per task; runs have the same buckets, so no run is shuffled again, and joins of them merge.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int = BUCKETS):
        self.spark, self.fanout, self.buckets, self.levels, self.tables = spark, fanout, buckets, [], []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _table(self, run: DataFrame, tag: str) -> DataFrame:
        """run as a bucketed table in the shared folder; one sorted file a bucket."""
        name = f"chronoglass_{tag}_{uuid.uuid4().hex}"
        with _sorted_scans(self.spark):
            run.repartition(self.buckets, *HASHES).write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", new_folder(self.spark, tag)).saveAsTable(name)
        self.tables.append(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs merged two at a time: counts add up, and the top is that of the run that opened the key."""
        out = runs[0]
        for run in runs[1:]:
            more = run.select(*HASHES, F.col("n_docs").alias("n2"), F.col("top").alias("top2"))
            out = out.join(more.hint("merge"), HASHES, "full").select(*HASHES, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n2", F.lit(0))).alias("n_docs"), F.coalesce("top", "top2").alias("top"))
        return out

    def _push(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._push(self._table(self._merged(full), f"run{level + 1}"), level + 1)

    def add(self, lines: DataFrame) -> DataFrame:
        """Takes in (doc_id, h1, h2), of which rows may repeat; returns the batch's run: top is null unless fresh."""
        n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))  # rows without one are one document
        batch = self._table(lines.groupBy(*HASHES).agg(n.alias("n_docs"), F.max("doc_id").alias("top")), "batch")
        with _sorted_scans(self.spark):
            fresh = batch
            for run in self.runs():
                fresh = fresh.join(run.select(*HASHES).hint("merge"), HASHES, "left_anti")
            out = batch
            if self.runs():
                opened = fresh.select(*HASHES, "top")
                out = self._table(batch.drop("top").join(opened.hint("merge"), HASHES, "left"), "run0")
            self._push(out, 0)
        return out

    def totals(self) -> DataFrame:
        """All runs as one, written: n_docs and top over all batches."""
        with _sorted_scans(self.spark):
            return materialise(self._merged(self.runs()), "totals")

    def close(self) -> None:
        """Forgets the tables; their files stay."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batches(lines: DataFrame, n: int) -> list[Column]:
    """Conditions on doc_id that part lines into n batches of about equal size, largest identifiers first."""
    cuts = lines.agg(F.percentile_approx("doc_id", [1 - k / n for k in range(1, n)], 10_000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    above = [F.lit(True), *(F.coalesce(F.col("doc_id") <= c, F.lit(True)) for c in cuts)]
    below = [*(F.coalesce(F.col("doc_id") > c, F.lit(False)) for c in cuts), F.lit(True)]
    return [a & b for a, b in zip(above, below, strict=True)]


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text (the lines kept), n_lines, n_dropped.

    Lines split at \\n; a line's key is the line stripped of blanks, A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs documents lose their lines in all documents but the one with the largest identifier that
    holds them; there all their lines stay. Documents come in batches from the largest identifiers down, so the batch
    whose anti-join with the runs leaves a key fresh holds the document that keeps it. A null text is one empty line.
    Rows that share an identifier count as one document and lose the same lines; rows with a null identifier are one
    document below all others, but are joined as rows of their own. Other columns don't matter.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole(text).alias("text"))
    lines = materialise(lines_of(rows, min_chars), "lines")
    size = lines.count()
    runs = LineRuns(spark, buckets=max(BUCKETS, size // BUCKET_LINES))
    for part in _batches(lines, batches or max(BATCHES, -(-size // BATCH_LINES))):
        runs.add(lines.where(part).select("doc_id", *HASHES))
    repeated = materialise(runs.totals().where(F.col("n_docs") >= min_docs).select(*HASHES, "top"), "repeated")
    runs.close()
    losing = spread_join(lines, repeated, HASHES).where(~F.col("doc_id").eqNullSafe(F.col("top")))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("d"), "t1", "t2").alias("row")
    losing = materialise(losing.select(key, "at").groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("losing")), "losing")
    keyed = rows.withColumn("t1", F.xxhash64("text")).withColumn("t2", F.xxhash64(F.lit(1), F.col("text"))).select("doc_id", "text", key)
    # kept lines are the stretches between the lost ones
    split, lost = F.split("text", "\n", -1), F.col("losing")
    n, m = F.size(split), F.size("losing")
    after = F.transform(F.sequence(F.lit(0), m), lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(lost, k - 1) + 1))
    kept = F.flatten(F.transform(after, lambda start, k: F.slice(split, start + 1, F.coalesce(F.get(lost, k), n) - start)))
    joined = keyed.join(losing, "row", "left")  # many rows of one identifier and text are a skewed side, which Spark splits
    return joined.select(
        "doc_id", F.when(F.col("losing").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        n.cast("long").alias("n_lines"), F.when(F.col("losing").isNull(), F.lit(0)).otherwise(m).cast("long").alias("n_dropped"),
    )
