"""Cohort statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import average_rank, cumulated, ranked


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, average_rank(x, by).alias("rx"), average_rank(y, by).alias("ry"))
    return r.groupBy(*by).agg(F.when(F.count("*") >= 3, F.corr("rx", "ry")).alias("rho"), F.count("*").alias("n"))


def separation(df: DataFrame, x: str, label: str) -> DataFrame:
    """(auc, n1, n0) = P(positive > negative) + P(equal) / 2, from counts per value: no pair of rows is made."""
    c = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    c = cumulated(c, x, ["n"]).withColumn("u", F.col("p") * (F.col("below_n") + F.col("n") / 2))
    return c.agg((F.sum("u") / F.nullif(F.sum("p") * F.sum("n"), F.lit(0))).alias("auc"), F.sum("p").alias("n1"), F.sum("n").alias("n0"))


def agreement(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """ICC(A,1), concordance, Bland-Altman limits and MDC95 of pairs."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("m", (F.col(a) + F.col(b)) / 2).withColumn("d", F.col(a) - F.col(b))
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("bias"), F.var_samp("d").alias("vd"), F.var_samp("m").alias("vm"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"), F.covar_pop(a, b).alias("cab"), F.avg(a).alias("ma"), F.avg(b).alias("mb"))
    msr, mse, msc = 2 * F.col("vm"), F.col("vd") / 2, F.col("n") * F.col("bias") ** 2 / 2
    icc = (msr - mse) / (msr + mse + 2 * (msc - mse) / F.col("n"))
    ccc = 2 * F.col("cab") / (F.col("va") + F.col("vb") + (F.col("ma") - F.col("mb")) ** 2)
    sd = F.sqrt("vd")
    return g.select(*by, "n", icc.alias("icc"), ccc.alias("ccc"), "bias", (F.col("bias") - 1.96 * sd).alias("low"), (F.col("bias") + 1.96 * sd).alias("high"), (1.96 * math.sqrt(2) * F.sqrt(mse)).alias("mdc95"))


def holm(df: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Each p against its own threshold; df has a row per test."""
    w, m = Window.orderBy(p), F.count("*").over(Window.partitionBy())
    return df.withColumn("threshold", F.lit(alpha) / (m - F.row_number().over(w) + 1)).withColumn("rejects", F.col(p) < F.col("threshold"))


def threshold_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(threshold, sensitivity, specificity) for each distinct score, from counts per score."""
    c = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("threshold")).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    c = cumulated(c, "threshold", ["p", "n"])
    return c.select("threshold", (1 - F.col("below_p") / F.nullif("all_p", F.lit(0))).alias("sensitivity"), (F.col("below_n") / F.nullif("all_n", F.lit(0))).alias("specificity"))


def theil_sen(df: DataFrame, x: str, y: str) -> DataFrame:
    """Median of slopes between an id's points, few of them (nights)."""
    a, b = df.select("id", F.col(x).alias("x0"), F.col(y).alias("y0")), df.select("id", F.col(x).alias("x1"), F.col(y).alias("y1"))
    return a.join(b, "id").where("x1 > x0").groupBy("id").agg(F.median((F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))).alias("slope"), F.count("*").alias("pairs"))


def index_quantile(x: str, p: float):
    """sorted[round(p (n - 1))], half to even."""
    a = F.array_sort(F.collect_list(x))
    return F.element_at(a, (F.bround(p * (F.size(a) - 1)) + 1).cast("int"))


def wilcoxon(d: np.ndarray) -> tuple[float, float]:
    """Signed-rank sum and its two-sided normal p; zeros are left out."""
    d = d[d != 0]
    r = pd.Series(np.abs(d)).rank().to_numpy()
    n, t = len(d), float(r[d > 0].sum())
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum(c**3 - c for c in np.unique(r, return_counts=True)[1]) / 48) if n else 0.0
    return t, math.erfc(abs(t - n * (n + 1) / 4) / sd / math.sqrt(2)) if sd else 1.0


def sign_test(d: np.ndarray) -> float:
    n, k = int((d != 0).sum()), int((d > 0).sum())
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n) if n else 1.0


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    cdf = lambda k, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))

    def root(f) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if f(mid) > 0 else (lo, mid)
        return lo

    return (root(lambda p: alpha / 2 - (1 - cdf(k - 1, p))) if k else 0.0), (root(lambda p: cdf(k, p) - alpha / 2) if k < n else 1.0)


def normal_tail(z: Column) -> Column:
    """erfc(|z| / sqrt 2), the two-sided tail: the normal integral's power series near 0, its continued fraction beyond 3.
    Both are folds over fixed steps, so that the column stays small and in the JVM."""
    density = lambda a: F.exp(-a * a / 2) / math.sqrt(2 * math.pi)
    steps = F.sequence(F.lit(1), F.lit(60))
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def grown(a: Column, acc: Column, k: Column) -> Column:
        t = acc["t"] * a * a / (2 * k + 1)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    def of(a: Column) -> Column:
        series = a * F.aggregate(steps, start, lambda acc, k: grown(a, acc, k), lambda acc: acc["s"])
        fraction = F.aggregate(F.reverse(steps), a, lambda acc, k: a + k / acc)
        return F.when(a < 3, 1 - 2 * density(a) * series).otherwise(2 * density(a) / fraction)

    return F.get(F.transform(F.array(F.abs(z)), of), F.lit(0))


def rank_sum(df: DataFrame, x: str, label: str) -> DataFrame:
    """(u, auc, p, n1, n0): Mann-Whitney with ties, two-sided by the normal form with continuity; counts per value only."""
    c = df.where(F.col(x).isNotNull()).groupBy(x).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    t = F.col("p") + F.col("n")
    s = cumulated(c, x, ["n"]).withColumn("u", F.col("p") * (F.col("below_n") + F.col("n") / 2)).agg(F.sum("u").alias("u"), F.sum("p").alias("n1"), F.sum("n").alias("n0"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n1") + F.col("n0")
    sd = F.sqrt(F.col("n1") * F.col("n0") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n0") / 2) - 0.5, F.lit(0.0)) / sd
    return s.select("u", (F.col("u") / (F.col("n1") * F.col("n0"))).alias("auc"), z.alias("z"), normal_tail(z).alias("p"), "n1", "n0")


def friedman(df: DataFrame, block: str, treatment: str, x: str) -> DataFrame:
    """(chi2, blocks, treatments) with ties, over blocks that have a row for every treatment."""
    k = df.select(treatment).distinct().count()
    w = Window.partitionBy(block)
    r = df.withColumn("_n", F.count("*").over(w)).where(F.col("_n") == k).withColumn("r", average_rank(x, [block]))
    t = F.count("*").over(Window.partitionBy(block, x))
    r = r.withColumn("tie", t * t - 1)  # summed over the t equal rows: t^3 - t
    total = r.groupBy(treatment).agg(F.sum("r").alias("s"), F.count("*").alias("n"), F.sum("tie").alias("tie"))
    out = total.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("blocks"), F.sum("tie").alias("ties"))
    b, k = F.col("blocks"), F.lit(k)
    chi2 = (12 / (b * k * (k + 1)) * F.col("ss") - 3 * b * (k + 1)) / (1 - F.col("ties") / (b * k * (k * k - 1)))
    return out.select(chi2.alias("chi2"), "blocks", k.cast("long").alias("treatments"))


def exact_mean(v: Column) -> Column:
    """Mean that doesn't depend on the order of rows, so that equal means are equal: from a decimal sum where no value has
    more than six decimals, else the plain one."""
    exact = v.try_cast("decimal(18,6)")
    return F.when(F.count(v) == F.count_if(exact.cast("double") == v), F.sum(exact).cast("double") / F.nullif(F.count(v), F.lit(0))).otherwise(F.avg(v))


def paired(df: DataFrame, a: str, b: str, ties: str = "average") -> DataFrame:
    """(n, mean, d, up, down, signed): differences a - b, Cohen's d, their signs and the signed-rank sum, ties as ranked()
    has them."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b)).withColumn("m", F.abs(F.col(a) - F.col(b))).withColumn("zero", (F.col("d") == 0).cast("int"))
    x = ranked(x.withColumn("m", F.when(F.col("d") != 0, F.col("m"))), "m", "r", ties)
    return x.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), (F.avg("d") / F.stddev_samp("d")).alias("d"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"), F.sum(F.when(F.col("d") > 0, F.col("r"))).alias("signed"))


def partial_spearman(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """(rho, n): rank correlation of x and y without what ranks of z explain in both."""
    r = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(z).isNotNull()).select(*(F.col(c).alias(f"x_{n}") for c, n in ((x, "a"), (y, "b"), (z, "c"))))
    for n in "abc":
        r = ranked(r, f"x_{n}", n)
    k = r.agg(F.corr("a", "b").alias("ab"), F.corr("a", "c").alias("ac"), F.corr("b", "c").alias("bc"), F.count("*").alias("n"))
    return k.select(((F.col("ab") - F.col("ac") * F.col("bc")) / F.sqrt((1 - F.col("ac") ** 2) * (1 - F.col("bc") ** 2))).alias("rho"), "n")


def redundancy(df: DataFrame, columns: list[str], flags: tuple = (0.5, 0.7)) -> DataFrame:
    """(a, b, rho, level) for each pair of columns: rank correlation, and how many of the flags its size reaches."""
    ranks = df.select(*(F.col(c).alias(f"x_{c}") for c in columns))
    for c in columns:
        ranks = ranked(ranks, f"x_{c}", c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = ranks.agg(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("rho")) for a, b in pairs)).alias("x"))
    out = row.select(F.explode("x").alias("x")).select("x.*")
    return out.withColumn("level", sum((F.abs("rho") >= f).cast("int") for f in flags))


def screening(df: DataFrame, outcome: str, columns: list[str], top: int = 15) -> DataFrame:
    """(column, r): Pearson correlations with the outcome by size, of columns that are complete and vary."""
    row = df.agg(F.array(*(F.struct(F.lit(c).alias("column"), F.when((F.count(c) == F.count(F.lit(1))) & (F.stddev_samp(c) > 0), F.corr(c, outcome)).alias("r")) for c in columns)).alias("x"))
    out = row.select(F.explode("x").alias("x")).select("x.*").where(F.col("r").isNotNull())
    return out.orderBy(F.abs("r").desc(), "column").limit(top)


def high_minus_low(df: DataFrame, key: str, x: str) -> DataFrame:
    """(id, delta): x at the largest key less x at the smallest, of ids that have two keys."""
    return df.groupBy("id").agg((F.max_by(x, key) - F.min_by(x, key)).alias("delta"), F.count_distinct(key).alias("_n")).where("_n > 1").drop("_n")


def calibration(df: DataFrame, p: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, expected, observed, brier) of probabilities in equal bins."""
    x = df.withColumn("bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long"))
    return x.groupBy("bin").agg(F.count("*").alias("n"), F.avg(p).alias("expected"), F.avg(label).alias("observed"), F.avg((F.col(p) - F.col(label)) ** 2).alias("brier"))


def proportional_bias(df: DataFrame, a: str, b: str) -> DataFrame:
    """(slope, r, sem): of the difference on the mean of pairs; the standard error of measurement."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(a) - F.col(b)).withColumn("m", (F.col(a) + F.col(b)) / 2)
    return x.agg(F.regr_slope("d", "m").alias("slope"), F.corr("d", "m").alias("r"), (F.stddev_samp("d") / math.sqrt(2)).alias("sem"))
