"""Resampling without moving rows: each row's weight in a replicate follows from a hash of its key and the replicate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import cut
from .windows import cumulated, ranked

#: Where a uniform number gives 0, 1, 2, ... of a Poisson variable of mean 1; the rest of its mass is under 1e-13.
POISSON = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(15)]


def uniform(key: Column, rep: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the first 32 bits of a hash of key, replicate and salt."""
    text = F.concat_ws(":", key.cast("string"), rep.cast("string"), F.lit(salt)) if salt else F.concat_ws(":", key.cast("string"), rep.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def poisson_weight(u: Column) -> Column:
    return sum(((u >= F.lit(c)).cast("int") for c in POISSON), F.lit(0))


def weighted(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """df once for each replicate in which its rows count, with rep and w, how often. Rows of one key have one weight, so
    a key may be a row's or a cluster's. Replicates are made row by row and end in their sums: nothing is collected."""
    reps = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return reps.withColumn("w", poisson_weight(uniform(F.col(key), F.col("rep"), salt))).where("w > 0")


def agreement_sums(a: str, b: str, w: Column, tag: str = "") -> list[Column]:
    """Weighted sums from which icc() follows; rows with a null side count in none."""
    ok = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), w)
    m, d = (F.col(a) + F.col(b)) / 2, F.col(a) - F.col(b)
    return [F.sum(ok * x).alias(f"{tag}{n}") for n, x in (("n", F.lit(1)), ("m", m), ("mm", m * m), ("d", d), ("dd", d * d))]


def icc(tag: str = "") -> Column:
    """ICC(A,1) of two columns from agreement_sums(); null under three rows or where nothing varies."""
    n, m, mm, d, dd = (F.col(f"{tag}{x}") for x in ("n", "m", "mm", "d", "dd"))
    n, less = F.nullif(n, F.lit(0)), F.nullif(n - 1, F.lit(0))
    within = (dd - d * d / n) / 2 / less
    rows, columns = 2 * (mm - m * m / n) / less, d * d / n / 2
    below = rows + within + 2 * (columns - within) / n
    return F.when((n >= 3) & (F.abs(below) > 1e-12), (rows - within) / below)


def interval(df: DataFrame, value: str, by: list[str], n: int, level: float = 0.95) -> DataFrame:
    """(by, low, high, reps): the quantiles of the replicates' values, null where under half of n have one."""
    tail = (1 - level) / 2
    some = df.where(F.col(value).isNotNull()).groupBy(*by).agg(*(F.percentile(value, F.lit(q)).alias(c) for c, q in (("low", tail), ("high", 1 - tail))), F.count("*").alias("reps"))
    return some.select(*by, *(F.when(F.col("reps") * 2 >= n, F.col(c)).alias(c) for c in ("low", "high")), "reps")


def bootstrap_icc(df: DataFrame, key: str, a: str, b: str, by: list[str], n: int = 300, least: int = 20) -> DataFrame:
    """(by, icc, n_pairs, low, high, reps): ICC(A,1) of complete pairs, and the interval of n Poisson resamples of keys.

    Each replicate gives each key a Poisson weight of mean 1, which is the bootstrap's multinomial weight for many keys;
    the sums of a replicate add up over partitions. Groups of fewer than `least` pairs have no interval."""
    whole = df.groupBy(*by).agg(*agreement_sums(a, b, F.lit(1))).withColumn("icc", icc()).select(*by, "icc", F.coalesce("n", F.lit(0)).cast("long").alias("n_pairs"))
    reps = weighted(df, key, n).groupBy(*by, "rep").agg(*agreement_sums(a, b, F.col("w"))).withColumn("value", icc())
    ends = interval(reps, "value", by, n)
    out = whole.join(ends, by, "left") if by else whole.join(ends, how="left")
    return out.select(*by, "icc", "n_pairs", *(F.when(F.col("n_pairs") >= least, F.col(c)).alias(c) for c in ("low", "high", "reps")))


def bootstrap_improvement(df: DataFrame, key: str, first: tuple[str, str], second: tuple[str, str], n: int = 300) -> DataFrame:
    """(first, second, delta, low, high, better): the ICC of two pairs of columns over keys that have all four, the second's
    less the first's, its interval when both are taken of the same resamples, and the part of these in which it is over 0."""
    full = df.dropna(subset=[*first, *second])
    sums = lambda w: [*agreement_sums(*first, w, "a_"), *agreement_sums(*second, w, "b_")]
    both = lambda x: x.withColumn("first", icc("a_")).withColumn("second", icc("b_")).withColumn("delta", F.col("second") - F.col("first"))
    reps = both(weighted(full, key, n).groupBy("rep").agg(*sums(F.col("w"))))
    ends = reps.agg(*(F.percentile("delta", F.lit(q)).alias(c) for c, q in (("low", 0.025), ("high", 0.975))), F.avg((F.col("delta") > 0).cast("int")).alias("better"))
    return both(full.agg(*sums(F.lit(1)))).select("first", "second", "delta").join(ends)


def bootstrap_mean_difference(df: DataFrame, key: str, x: str, label: str, n: int = 300) -> DataFrame:
    """(delta, low, high): mean of x where label is 1 less that where it is 0, and the interval over resamples of each
    group by itself: as the weights of the two are drawn apart, a replicate is stratified."""
    ok = df.where(F.col(x).isNotNull() & F.col(label).isNotNull())
    means = lambda w: [F.sum(F.when(F.col(label) == k, F.col(x) * w)) / F.nullif(F.sum(F.when(F.col(label) == k, w)), F.lit(0)) for k in (1, 0)]
    of = lambda w: (means(w)[0] - means(w)[1]).alias("delta")
    reps = weighted(ok, key, n).groupBy("rep").agg(of(F.col("w")))
    ends = reps.agg(*(F.percentile("delta", F.lit(q)).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))
    return ok.agg(of(F.lit(1))).join(ends)


def _hashed(df: DataFrame, key: str, n: int) -> DataFrame:
    """df once for each of n shuffles, with rep, _h, the hash that orders it, and _b, the hash's first 8 bits. A null key
    comes last. Rows are dealt first, so that few rows with many shuffles don't stay in few tasks."""
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    reps = df.repartition(parts).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    text = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("rep").cast("string"))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")
    return reps.withColumn("_h", F.coalesce(h, F.lit(1 << 60))).withColumn("_b", F.shiftright("_h", 52))


def _below(reps: DataFrame, *sums: Column) -> DataFrame:
    """(rep, _b, _n, ...): rows of each bin of hashes and below_ those of the bins before, likewise the sums; 257 bins at
    most for a shuffle."""
    before = Window.partitionBy("rep").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = reps.groupBy("rep", "_b").agg(F.count("*").alias("_n"), *(c.alias(f"_s{k}") for k, c in enumerate(sums)))
    names = ["_n", *(f"_s{k}" for k in range(len(sums)))]
    return bins.select("rep", "_b", "_n", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"below{c}") for c in names))


def shuffled(df: DataFrame, key: str, n: int) -> DataFrame:
    """df once for each of n shuffles, with rep and place, its row's place in it from 1: the order of a hash of the key and
    the replicate, and of the key where hashes meet. Bins of hashes are counted, and rows are placed within their bin, so no
    task orders all rows and only the bins' counts are broadcast."""
    reps = _hashed(df, key, n)
    own = F.row_number().over(Window.partitionBy("rep", "_b").orderBy("_h", F.col(key).asc_nulls_last()))
    placed = reps.withColumn("_k", own).join(F.broadcast(_below(reps).select("rep", "_b", "below_n")), ["rep", "_b"])
    return placed.select(*df.columns, "rep", (F.col("below_n") + F.col("_k")).alias("place"))


def permuted_separation(df: DataFrame, key: str, x: str, label: str, n: int) -> DataFrame:
    """(rep, value): P(positive > negative) + P(equal) / 2 in n shuffles of the labels. Ranks are made once; a shuffle gives
    the label to the rows in its first places, as many as have it. These are whole bins of hashes, of which only sums are
    made, and the first rows of one bin, so a shuffle sorts that bin alone."""
    rows = ranked(df.where(F.col(x).isNotNull() & F.col(label).isNotNull()), x, "_r").select(F.col(key), "_r", F.col(label).cast("long").alias("_l"))
    rows = cut(rows, "ranks")
    total = rows.agg(F.sum("_l").alias("n1"), F.sum(1 - F.col("_l")).alias("n0"))
    reps = _hashed(rows.select(key, "_r"), key, n)
    edge = _below(reps, F.sum("_r")).join(F.broadcast(total)).where("below_n < n1 AND n1 <= below_n + _n")
    edge = cut(edge.select("rep", "_b", "n1", "n0", "below_n", "below_s0"), "edges")  # a row per shuffle
    first = F.row_number().over(Window.partitionBy("rep").orderBy("_h", F.col(key).asc_nulls_last()))
    won = reps.join(F.broadcast(edge), ["rep", "_b"]).withColumn("_k", first).where(F.col("below_n") + F.col("_k") <= F.col("n1"))
    s = won.groupBy("rep", "n1", "n0", "below_s0").agg(F.sum("_r").alias("s")).withColumn("s", F.col("s") + F.col("below_s0"))
    return s.select("rep", ((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / F.greatest(F.col("n1") * F.col("n0"), F.lit(1))).alias("value"))


def max_statistic(df: DataFrame, key: str, columns: list[str], label: str, n: int) -> DataFrame:
    """(column, stat, p): size of the rank correlation with the label, and the part of shuffles, with the real one, in which
    the largest of all columns reaches it. Rows with a null are left out."""
    rows = df.dropna(subset=[*columns, label]).select(key, *columns, label)
    for c in (*columns, label):
        rows = ranked(rows, c, f"_r_{c}")
    rows = cut(rows.select(key, *(f"_r_{c}" for c in (*columns, label))), "ranks")
    size = lambda c, y: F.coalesce(F.abs(F.corr(f"_r_{c}", y)), F.lit(0.0))
    real = rows.agg(F.array(*(F.struct(F.lit(c).alias("column"), size(c, f"_r_{label}").alias("stat")) for c in columns)).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    # the row at a place gets the label of the row with that place in the order of the key
    fixed = cumulated(rows.select(F.col(key).alias("_k"), F.lit(1).alias("_n"), F.col(f"_r_{label}").alias("_y")), "_k", ["_n"])
    mixed = shuffled(rows, key, n).join(fixed.select((F.col("below__n") + 1).alias("place"), "_y").hint("shuffle_hash"), "place")
    null = mixed.groupBy("rep").agg(F.greatest(*(size(c, "_y") for c in columns), F.lit(0.0)).alias("value"))
    met = real.join(null, F.col("value") >= F.col("stat") - 1e-12, "left")
    return met.groupBy("column", "stat").agg(((F.count("value") + 1) / (n + 1)).alias("p"))
