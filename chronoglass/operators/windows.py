"""Ordered analytics on readings and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import by_time


def average_rank(x: str, by: list[str]) -> Column:
    """Rank with ties averaged."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def true_runs(df: DataFrame, flag: str, least: int) -> DataFrame:
    """(id, start, stop, n): runs of rows on which flag holds, of at least `least` rows."""
    w = df.withColumn("p", F.row_number().over(by_time())).where(flag)
    w = w.withColumn("g", F.col("p") - F.row_number().over(by_time()))
    return w.groupBy("id", "g").agg(F.min("us").alias("start"), F.max("us").alias("stop"), F.count("*").alias("n")).where(F.col("n") >= least).drop("g")


def phase_runs(df: DataFrame, phase: str, order: str, least: int = 1) -> DataFrame:
    """(id, run, phase, n): maximal runs of one phase; a null phase ends a run."""
    w = Window.partitionBy("id").orderBy(order)
    x = df.withColumn("_new", (~F.col(phase).eqNullSafe(F.lag(phase).over(w))).cast("int")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where(F.col(phase).isNotNull()).groupBy("id", "run", F.col(phase).alias("phase")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def turning_points(df: DataFrame, dead: float = 0.01) -> DataFrame:
    """(id, us, v, kind): where the last clear direction, kept over flat steps and gaps, turns; the place is the row before."""
    d = F.col("v") - F.lag("v").over(by_time())
    x = df.withColumn("d", F.when(d > dead, 1).when(d < -dead, -1))
    x = x.withColumn("prev", F.last("d", True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))).withColumn("us0", F.lag("us").over(by_time())).withColumn("v0", F.lag("v").over(by_time()))
    return x.where("d = -prev").select("id", F.col("us0").alias("us"), F.col("v0").alias("v"), F.when(F.col("d") < 0, "peak").otherwise("valley").alias("kind"))


def _folded(df: DataFrame, keys: list[str], order: list, run, kinds: str) -> DataFrame:
    """run, a generator of batches, over rows with an id's together and in order: it carries what it must know of the id
    from row to row, so an id's rows are read once and never held."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kinds)


def _as_batch(rows: list[tuple], names: list[str], batch):
    import pyarrow as pa

    kinds = [batch.schema.field(n).type for n in names]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def merge_events(df: DataFrame, apart: int) -> DataFrame:
    """(id, at): events less than or `apart` after a kept one belong to it; the first of an id is kept."""

    def run(batches):
        own, anchor = None, None
        for b in batches:
            out = []
            for i, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if anchor is None or i != own or at - anchor > apart:
                    out.append((i, at))
                    own, anchor = i, at
            yield _as_batch(out, ["id", "at"], b)

    rows = df.select("id", "at").where("at IS NOT NULL")
    return _folded(rows, ["id"], ["at"], run, f"id {rows.schema['id'].dataType.simpleString()}, at {rows.schema['at'].dataType.simpleString()}")


def suppress(df: DataFrame, apart: int) -> DataFrame:
    """(id, at, v): events by falling v, the earlier first of equal ones, each kept if at least `apart` from all kept
    before. What an id has kept is held, sorted by time, so that only the two next to an event are looked at."""

    def run(batches):
        from bisect import bisect_left

        own, kept = object(), []
        for b in batches:
            out = []
            for i, at, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != own:
                    own, kept = i, []
                k = bisect_left(kept, at)
                if (k == len(kept) or kept[k] - at >= apart) and (k == 0 or at - kept[k - 1] >= apart):
                    kept.insert(k, at)
                    out.append((i, at, v))
            yield _as_batch(out, ["id", "at", "v"], b)

    rows = df.select("id", "at", "v").where("at IS NOT NULL AND v IS NOT NULL")
    return _folded(rows, ["id"], [F.desc("v"), "at"], run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def ema(df: DataFrame, alpha: float) -> DataFrame:
    """(id, seg, us, v): exponential average, begun anew in each segment; a null is passed over and stays null."""

    def run(batches):
        own, last = object(), None
        for b in batches:
            out = []
            for i, seg, us, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (i, seg) != own:
                    own, last = (i, seg), None
                if v is not None:
                    last = v if last is None else alpha * v + (1 - alpha) * last
                out.append((i, seg, us, None if v is None else last))
            yield _as_batch(out, ["id", "seg", "us", "v"], b)

    rows = df.select("id", "seg", "us", F.col("v").cast("double").alias("v"))
    return _folded(rows, ["id", "seg"], ["us"], run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def cumulated(df: DataFrame, x: str, sums: list[str], by: list[str] | None = None, parts: int = 64) -> DataFrame:
    """df, a row per (by, x), with below_c for each c of sums: its sum over the rows of smaller x, and all_c, over all.

    In two levels: approximate quantiles of x cut df into bins, whose sums are prefix-summed, `parts` rows at most for each
    value of by, and rows are added up within their bin alone. So no task orders all rows; rows of null x go."""
    by = by or []
    rows = df.where(F.col(x).isNotNull())
    cuts = sorted(set(rows.agg(F.percentile_approx(x, [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    place = lambda v: sum(((v > F.lit(c)).cast("int") for c in cuts), F.lit(0))  # noqa: E731  of a variable, so that x is worked out once
    held = rows.withColumn("_b", F.get(F.transform(F.array(F.col(x)), place), F.lit(0)))
    bins = held.groupBy(*by, "_b").agg(*(F.sum(c).alias(f"_s{k}") for k, c in enumerate(sums)))
    each = Window.partitionBy(*by)
    before, whole = each.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1), each.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    bins = bins.select(*by, "_b", *(F.coalesce(F.sum(f"_s{k}").over(before), zero).alias(f"_l{k}") for k in range(len(sums))), *(F.sum(f"_s{k}").over(whole).alias(f"all_{c}") for k, c in enumerate(sums)))
    within = Window.partitionBy(*by, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(F.broadcast(bins) if not by else bins, [*by, "_b"])
    return out.select(*df.columns, *((F.col(f"_l{k}") + F.coalesce(F.sum(c).over(within), zero)).alias(f"below_{c}") for k, c in enumerate(sums)), *(f"all_{c}" for c in sums))


def ranked(df: DataFrame, x: str, name: str, ties: str = "average") -> DataFrame:
    """df with the rank of x over all rows, ties averaged, or all the least of theirs (`least`): values are counted first,
    and ranked in two levels, so neither a common value nor the table meets in one task. Rows of null x have a null rank."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("_x")).agg(F.count("*").alias("_c"))
    within = F.lit(1.0) if ties == "least" else (F.col("_c") + 1) / 2
    ranks = cumulated(counts, "_x", ["_c"]).select("_x", (F.col("below__c") + within).alias(name))
    return df.join(ranks, F.col(x) == F.col("_x"), "left").drop("_x")


def average_precision(df: DataFrame, score: str, label: str, tie: str, parts: int = 256) -> DataFrame:
    """(ap): precision at each positive, averaged. Scores are ranked in two levels: bins' sizes are prefix-summed, then
    rows are ranked within their bin, so no task orders all rows."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    width = ((hi - lo) or 1) / parts if lo is not None else 1
    x = df.withColumn("_b", F.least(F.floor((F.col(score) - F.lit(lo)) / width), F.lit(parts - 1)))
    sizes = x.groupBy("_b").agg(F.count("*").alias("c"), F.sum(label).alias("p"))
    w = Window.orderBy(F.desc("_b"))  # at most `parts` rows
    base = sizes.select("_b", (F.sum("c").over(w) - F.col("c")).alias("c0"), (F.sum("p").over(w) - F.col("p")).alias("p0"))
    own = Window.partitionBy("_b").orderBy(F.desc(score), tie)
    y = x.join(F.broadcast(base), "_b").withColumn("k", F.col("c0") + F.row_number().over(own)).withColumn("tp", F.col("p0") + F.sum(label).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return y.agg((F.sum(F.when(F.col(label) == 1, F.col("tp") / F.col("k"))) / F.sum(label)).alias("ap"))
