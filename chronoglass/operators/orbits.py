"""Movement of embedded points about their core, delays by pairs, decaying averages, targets, links by place, samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .neighbours import distance
from .windows import _as_batch, _folded, cumulated, ranked

#: Where the standard normal reaches 0.1, ..., 0.9.
NORMAL_TENTHS = (-1.2815515655446004, -0.8416212335729143, -0.5244005127080407, -0.2533471031357997, 0.0, 0.2533471031357997, 0.5244005127080407, 0.8416212335729143, 1.2815515655446004)


def pair_delay(grid: DataFrame, top: int, least: int = 20, pairs: int = 10, low: float = 0.8, order: str = "us") -> DataFrame:
    """(id, tau): the first lag under `top` whose autocorrelation is below 1 / e, or the one before a lag at which it rises
    again after it was under `low`; else `top`. A lag's products are over the pairs that are both known, about the mean and
    by the variance of all known values; under `pairs` of them it counts as 0. An id with fewer than `least` known values,
    or none that differ, has 1. Rows are a grid with nulls in its gaps."""
    w = Window.partitionBy("id")
    x = grid.select("id", order, "v", F.avg("v").over(w).alias("m"))
    d = F.col("v") - F.col("m")
    x = x.select("id", order, d.alias("d"))
    ahead = w.orderBy(order)
    x = x.select("id", "d", *(F.lead("d", k).over(ahead).alias(f"d{k}") for k in range(1, top + 1)))
    sums = [F.struct(F.count(F.col("d") * F.col(f"d{k}")).alias("n"), F.avg(F.col("d") * F.col(f"d{k}")).alias("p")) for k in range(1, top + 1)]
    s = x.groupBy("id").agg(F.count("d").alias("n"), F.avg(F.col("d") * F.col("d")).alias("var"), F.array(*sums).alias("p"))
    r = F.concat(F.array(F.lit(1.0)), F.transform("p", lambda p: F.when(p["n"] >= pairs, p["p"] / F.nullif("var", F.lit(0.0))).otherwise(0.0)))
    s = s.withColumn("r", r)
    at = lambda k: F.get("r", k)
    under = lambda k: at(k) < 1 / math.e
    turns = lambda k: F.exists(F.slice("r", 2, k), lambda v: v < low) & (at(k) > at(k - 1)) & (at(k + 1) >= at(k))
    first = F.get(F.filter(F.sequence(F.lit(1), F.lit(top - 1)), lambda k: under(k) | turns(k)), F.lit(0))
    s = s.withColumn("k", first)
    tau = F.when((F.col("n") < least) | (F.col("var") <= 1e-12), 1).when(F.col("k").isNull(), top).when(under(F.col("k")), F.col("k")).otherwise(F.greatest(F.lit(1), F.col("k") - 1))
    return s.select("id", tau.cast("int").alias("tau"))


def friction(points: DataFrame, dim: int, dead: float = 0.01, least: float = 1e-9) -> DataFrame:
    """(id, ascend, descend, recovery): over neighbouring points, the mean distance from the core by the step's length where
    the first coordinate rises by more than `dead`, and where it falls; and the mean step that brings a point nearer to the
    core than the one before, by the first coordinate's deviation. The core is the median point. A step after a gap has no
    one before. Nulls where no step counts or nothing varies."""
    part = lambda k: F.get("pt", F.lit(k))
    core = points.groupBy("id").agg(F.array(*(F.median(part(k)) for k in range(dim))).alias("core"), F.stddev_samp(part(0)).alias("sd"))
    w = Window.partitionBy("id").orderBy("idx")
    x = points.join(core, "id").withColumn("far", distance(F.col("pt"), F.col("core")))
    x = x.select("*", F.lag("pt").over(w).alias("pt0"), (F.lag("idx").over(w) == F.col("idx") - 1).alias("next"))
    x = x.select("*", F.when(F.lag("next").over(w), F.lag("far").over(w)).alias("far0")).where("next")
    x = x.withColumn("step", distance(F.col("pt"), F.col("pt0"))).withColumn("dx", part(0) - F.get("pt0", F.lit(0)))
    ratio = F.when(F.col("step") > least, F.col("far") / F.nullif("step", F.lit(0.0)))
    back = F.avg(F.when(F.col("far") < F.col("far0"), F.col("step")))
    return x.groupBy("id").agg(F.avg(F.when(F.col("dx") > dead, ratio)).alias("ascend"), F.avg(F.when(F.col("dx") < -dead, ratio)).alias("descend"), F.when(F.first("sd") > 1e-9, back / F.nullif(F.first("sd"), F.lit(0.0))).alias("recovery"))


def decaying_average(df: DataFrame, alpha: float) -> DataFrame:
    """(id, us, v): the average in which what came before loses 1 - alpha of its weight with every row, known or not, and a
    known value has alpha; null where v is. So a gap lets old values fade, where ema() stands still."""

    def run(batches):
        own, last, weight = object(), None, 1.0
        for b in batches:
            out = []
            for i, us, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i != own:
                    own, last = i, None
                if last is None:
                    last, weight = v, 1.0
                else:
                    weight *= 1 - alpha
                    if v is not None:
                        last, weight = (weight * last + alpha * v) / (weight + alpha), 1.0
                out.append((i, us, None if v is None else last))
            yield _as_batch(out, ["id", "us", "v"], b)

    rows = df.select("id", "us", F.col("v").cast("double").alias("v"))
    return _folded(rows, ["id"], ["us"], run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


def percentile_target(df: DataFrame, a: str, b: str, at: float = 0.75) -> DataFrame:
    """df's complete rows with target, the mean of (rank - 1/2) / n of a and b, ties averaged, and high, whether it reaches
    the exact quantile of all."""
    rows = ranked(ranked(df.dropna(subset=[a, b]), a, "_ra"), b, "_rb")
    n = rows.agg(F.count("*").alias("_n"))
    rows = rows.join(F.broadcast(n)).withColumn("target", ((F.col("_ra") - 0.5) / F.col("_n") + (F.col("_rb") - 0.5) / F.col("_n")) / 2).drop("_ra", "_rb", "_n")
    limit = rows.agg(F.percentile("target", F.lit(at)).alias("_limit"))
    return rows.join(F.broadcast(limit)).withColumn("high", F.col("target") >= F.col("_limit")).drop("_limit")


def linked_by_place(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """a's rows beside b's in the same place of their orders, which must have no equal values; fails unless both have the
    same number of rows. Places are counted in two levels, so no task orders a table. Columns must differ in name."""
    placed = lambda df, c: cumulated(df.withColumn("_one", F.lit(1)), c, ["_one"]).withColumnRenamed("below__one", "_place")
    x, y = placed(a, order_a).drop("_one"), placed(b, order_b).drop("_one").withColumnRenamed("all__one", "_other")
    both = x.join(y, "_place", "full")
    same = F.coalesce("all__one", F.lit(-1)) == F.coalesce("_other", F.lit(-1))
    return both.where(F.when(same, True).otherwise(F.raise_error(F.lit("the tables differ in their number of rows")).cast("boolean"))).drop("_place", "all__one", "_other")


def with_static(df: DataFrame, static: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """df with columns of static, of each id its first row in order; ids that have none get nulls."""
    first = static.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_s")).select("id", "_s.*")
    return df.join(first, "id", "left")


def backtest_samples(samples: DataFrame, stride: int) -> DataFrame:
    """Of samples (id, seg, us, ...) every stride-th of a segment, from its first on."""
    k = F.row_number().over(Window.partitionBy("id", "seg").orderBy("us")) - 1
    return samples.withColumn("_k", k).where(F.col("_k") % stride == 0).drop("_k")


def inference_samples(samples: DataFrame, past: int, step_us: int) -> DataFrame:
    """Of samples the last of each segment: past is what a forecast is made from, `begins` its first time, future what came."""
    last = F.row_number().over(Window.partitionBy("id", "seg").orderBy(F.desc("us")))
    return samples.withColumn("_k", last).where("_k = 1").drop("_k").withColumn("begins", F.col("us") + past * step_us)


def kept_points(df: DataFrame, n: int | None = None, share: float | None = None, seed: int = 0) -> DataFrame:
    """Of each id n points, or the part `share` rounded up, the first by a hash of id, time and seed: the same ones however
    the table lies or a task is run again, and of n the union of parts' first n holds the whole's."""
    h = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("us").cast("string"), F.lit(str(seed))), 256)
    own = Window.partitionBy("id").orderBy("_h", "us")
    x = df.withColumn("_h", h).withColumn("_k", F.row_number().over(own))
    if share is not None:
        x = x.withColumn("_n", F.count("*").over(Window.partitionBy("id"))).where(F.col("_k") <= F.ceil(F.col("_n") * share)).drop("_n")
    else:
        x = x.where(F.col("_k") <= n)
    return x.drop("_h", "_k")


def thinned(df: DataFrame, most: int) -> DataFrame:
    """Of ids with more than `most` rows every k-th in time, with the least whole k that leaves no more; others whole."""
    w = Window.partitionBy("id")
    x = df.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy("us")) - 1)
    return x.where(F.col("_k") % F.greatest(F.lit(1), F.ceil(F.col("_n") / most)) == 0).drop("_n", "_k")


def gaussian_calibration(forecasts: DataFrame) -> DataFrame:
    """(k, n, error) of (k, forecast, actual): for each step ahead the sum over p = 0, 0.1, ..., 1 of the squared distance of
    p from the part of actual values at or below the p-quantile of a normal about the forecast, of the mean squared error of
    all steps. Each quantile is a fixed multiple of the deviation, so no distribution function is needed."""
    d = F.col("actual") - F.col("forecast")
    sd = forecasts.agg(F.sqrt(F.avg(d * d)).alias("_sd"))
    z = forecasts.join(F.broadcast(sd)).select("k", (d / F.nullif("_sd", F.lit(0.0))).alias("z")).where("z IS NOT NULL")
    parts = [F.avg((F.col("z") <= q).cast("int")) - (i + 1) / 10 for i, q in enumerate(NORMAL_TENTHS)]
    return z.groupBy("k").agg(F.count("*").alias("n"), sum((p * p for p in parts), F.lit(0.0)).alias("error"))


def count_confound(counts: DataFrame, x: str, n: str = "n") -> DataFrame:
    """(bucket, ids, var, r): the variance of x among ids with so many events, 3 standing for more, and its correlation with
    the number over all ids."""
    r = counts.agg(F.corr(n, x).alias("r"))
    by = counts.groupBy(F.least(F.col(n), F.lit(3)).cast("int").alias("bucket")).agg(F.count("*").alias("ids"), F.var_pop(x).alias("var"))
    return by.join(F.broadcast(r))


def score_drift(scores: DataFrame, order: str, score: str) -> DataFrame:
    """scores with drift, the size of the change since the id's score before in order; 0 for the first."""
    before = F.lag(score).over(Window.partitionBy("id").orderBy(order))
    return scores.withColumn("drift", F.abs(F.col(score) - F.coalesce(before, F.col(score))))


def flattened(df: DataFrame, separator: str = ".") -> DataFrame:
    """df with each struct's fields, and theirs, as columns named by their way in; arrays and maps stay whole."""

    def leaves(kind: StructType, way: list[str]) -> list[Column]:
        out = []
        for f in kind.fields:
            own = [*way, f.name]
            if isinstance(f.dataType, StructType):
                out += leaves(f.dataType, own)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in own)).alias(separator.join(own)))
        return out

    return df.select(*leaves(df.schema, []))
