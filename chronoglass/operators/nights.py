"""Grids by first reading, overlapping night windows with a coverage gate, anchors of calm windows, prefixes of nights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MINUTE
from .series import lerp

#: A night window is calm by its spread, its change in five minutes, and twice the part of its steps steeper than this.
STEEP = 0.30
COVERAGE, LOWEST, ENVELOPE, NIGHTS = 0.80, 0.01, 0.30, 6


def resample_first(df: DataFrame, step: int, fill: int) -> DataFrame:
    """(id, us, v) on a clock-aligned grid of `step` minutes from an id's first reading to its last: the first reading of a
    bin, and between two of them a straight line over up to `fill` empty bins; longer gaps stay null, all of them."""
    s = step * MINUTE
    bins = df.where("v IS NOT NULL").groupBy("id", (F.floor(F.col("us") / s) * s).cast("long").alias("bin")).agg(F.min_by("v", "us").alias("v"))
    w = Window.partitionBy("id").orderBy("bin")
    x = bins.select("id", "bin", "v", F.lead("bin").over(w).alias("bin1"), F.lead("v").over(w).alias("v1"))
    x = x.select("*", F.explode(F.sequence("bin", F.coalesce(F.col("bin1") - s, F.col("bin")), F.lit(s).cast("long"))).alias("us"))
    inner = F.when((F.col("bin1") - F.col("bin")) / s - 1 <= fill, lerp(F.col("bin"), F.col("v"), F.col("bin1"), F.col("v1"), F.col("us")))
    return x.select("id", "us", F.when(F.col("us") == F.col("bin"), F.col("v")).otherwise(inner).alias("v"))


def fill_first(df: DataFrame, step: int, most: int) -> DataFrame:
    """(id, us, v) on a grid of `step` minutes: the mean of a bin, and of a gap the first `most` empty bins on a straight
    line to the next bin, whatever its length; the others stay null."""
    s = step * MINUTE
    bins = df.where("v IS NOT NULL").groupBy("id", (F.floor(F.col("us") / s) * s).cast("long").alias("bin")).agg(F.avg("v").alias("v"))
    w = Window.partitionBy("id").orderBy("bin")
    x = bins.select("id", "bin", "v", F.lead("bin").over(w).alias("bin1"), F.lead("v").over(w).alias("v1"))
    x = x.select("*", F.explode(F.sequence("bin", F.coalesce(F.col("bin1") - s, F.col("bin")), F.lit(s).cast("long"))).alias("us"))
    inner = F.when((F.col("us") - F.col("bin")) / s <= most, lerp(F.col("bin"), F.col("v"), F.col("bin1"), F.col("v1"), F.col("us")))
    return x.select("id", "us", F.when(F.col("us") == F.col("bin"), F.col("v")).otherwise(inner).alias("v"))


def _middle(values: Column) -> Column:
    """The median of a sorted array."""
    n = F.size(values)
    at = lambda k: F.get(values, k.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def eligible_nights(grid: DataFrame, step: int, night: int = 360, day: int = 1440, coverage: float = COVERAGE, most: int = NIGHTS) -> DataFrame:
    """(id, date, k): dates whose first `night` minutes have the coverage, numbered from 1 in order, the first `most`."""
    date = F.floor(F.col("us") / (day * MINUTE)).cast("long")
    into = F.pmod("us", F.lit(day * MINUTE))
    n = grid.where("v IS NOT NULL").where(into < night * MINUTE).groupBy("id", date.alias("date")).agg(F.count("*").alias("n"))
    least = -(-int(night / step) * coverage // 1)
    k = F.row_number().over(Window.partitionBy("id").orderBy("date"))
    return n.where(F.col("n") >= least).withColumn("k", k).where(F.col("k") <= most).select("id", "date", "k")


def night_windows(grid: DataFrame, step: int, night: int = 360, day: int = 1440, length: int = 90, stride: int = 15, coverage: float = COVERAGE, steep: float = STEEP, most: int = NIGHTS) -> DataFrame:
    """(id, date, start, median, mad, change, jumps, entropy): windows of `length` minutes every `stride`, inside the night,
    that have the coverage, of eligible nights. change is the median absolute step per five minutes, jumps the part of
    steps steeper than `steep` per minute, entropy = mad + change + 2 jumps. Steps are between known neighbours.

    Each reading goes to the few windows it lies in, and a window's readings, length / step at most, to one array, from
    which all its order statistics come."""
    ok = eligible_nights(grid, step, night, day, coverage, most)
    into = (F.pmod("us", F.lit(day * MINUTE)) / MINUTE).cast("long")
    x = grid.where("v IS NOT NULL").withColumn("date", F.floor(F.col("us") / (day * MINUTE)).cast("long")).withColumn("m", into).where(F.col("m") < night)
    first = F.greatest(F.ceil((F.col("m") - length + 1) / stride), F.lit(0))
    last = F.least(F.floor(F.col("m") / stride), F.lit((night - length) // stride))
    x = x.withColumn("a", first).withColumn("z", last).where("a <= z").select("id", "date", "us", "v", F.explode(F.sequence("a", "z")).alias("j"))
    w = x.groupBy("id", "date", (F.col("j") * stride).alias("start")).agg(F.sort_array(F.collect_list(F.struct("us", "v"))).alias("x"))
    w = w.where(F.size("x") >= -(-int(length / step) * coverage // 1)).join(ok.select("id", "date"), ["id", "date"])
    w = w.select("id", "date", "start", F.transform("x", lambda r: r["v"]).alias("v"))
    steps = F.zip_with(F.slice("v", 2, F.size("v")), F.slice("v", 1, F.size("v") - 1), lambda b, a: F.abs(b - a))
    w = w.withColumn("d", steps).withColumn("median", _middle(F.sort_array("v")))
    w = w.withColumn("mad", _middle(F.sort_array(F.transform("v", lambda v: F.abs(v - F.col("median"))))))
    w = w.withColumn("change", _middle(F.sort_array("d")) * 5.0 / step)
    w = w.withColumn("jumps", F.when(F.size("d") > 0, F.size(F.filter("d", lambda d: d / step > steep)) / F.size("d")).otherwise(0.0))
    return w.select("id", "date", "start", "median", "mad", "change", "jumps", (F.col("mad") + F.coalesce("change", F.lit(0.0)) + 2.0 * F.col("jumps")).alias("entropy"))


def anchors(windows: DataFrame, grid: DataFrame, night: int = 360, day: int = 1440, lowest: float = LOWEST, envelope: float = ENVELOPE, least: int = 4) -> DataFrame:
    """(id, level, entropy, dwell, drift, rises, nights): level and entropy are medians over the part `lowest` of an id's
    windows with the least entropy, one at least, the earliest of equals; dwell is the part of readings of nights with a
    window that lie within the envelope of the level; drift is Theil and Sen's slope of the nights' calmest medians over
    their number, rises the part that is above the one before, both of `least` nights at least."""
    order = ["entropy", "date", "start"]
    rank, n = F.row_number().over(Window.partitionBy("id").orderBy(*order)), F.count("*").over(Window.partitionBy("id"))
    low = windows.withColumn("_k", rank).withColumn("_n", n).where(F.col("_k") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * lowest)))
    level = low.groupBy("id").agg(F.median("median").alias("level"), F.median("entropy").alias("entropy"))
    best = windows.groupBy("id", "date").agg(F.min_by("median", F.struct("entropy", "start")).alias("y"))
    own = Window.partitionBy("id").orderBy("date")
    best = best.withColumn("x", F.row_number().over(own)).withColumn("up", (F.col("y") > F.lag("y").over(own)).cast("int"))
    rises = best.groupBy("id").agg(F.avg("up").alias("rises"), F.count("*").alias("nights"))
    pairs = best.alias("p").join(best.alias("q"), "id").where("q.x > p.x").groupBy("id").agg(F.median((F.col("q.y") - F.col("p.y")) / (F.col("q.x") - F.col("p.x"))).alias("drift"))
    date = F.floor(F.col("us") / (day * MINUTE)).cast("long")
    dwell = grid.where("v IS NOT NULL").where(F.pmod("us", F.lit(day * MINUTE)) < night * MINUTE).withColumn("date", date).join(best.select("id", "date"), ["id", "date"]).join(level.select("id", "level"), "id")
    dwell = dwell.groupBy("id").agg(F.avg((F.abs(F.col("v") - F.col("level")) <= envelope).cast("int")).alias("dwell"))
    out = level.join(rises, "id").join(dwell, "id").join(pairs, "id", "left")
    enough = lambda c: F.when(F.col("nights") >= least, F.col(c)).alias(c)
    return out.select("id", "level", "entropy", "dwell", enough("drift"), enough("rises"), "nights")


def night_prefix(df: DataFrame, nights: DataFrame, k: int, day: int = 1440) -> DataFrame:
    """Readings up to the end of an id's k-th night's day; ids with fewer nights have none."""
    end = nights.where(F.col("k") == k).select("id", ((F.col("date") + 1) * (day * MINUTE)).alias("_end"))
    return df.join(end, "id").where(F.col("us") < F.col("_end")).drop("_end")


def quantile_coverage(samples: DataFrame, draws: str, actual: str, levels: tuple = tuple(k / 20 for k in range(1, 20))) -> DataFrame:
    """(level, covered, n, error): the part of rows whose actual value is at most the level's quantile of their own draws,
    linear between ranks, and its squared distance from the level. Draws are one row's array; rows are never collected."""
    n = F.size(draws)
    x = samples.where((n > 0) & F.col(actual).isNotNull()).select(F.sort_array(draws).alias("s"), F.col(actual).alias("y"), F.explode(F.array(*map(F.lit, levels))).alias("level"))
    at = F.col("level") * (F.size("s") - 1)
    low = F.get("s", F.floor(at).cast("int"))
    q = low + (F.coalesce(F.get("s", (F.floor(at) + 1).cast("int")), low) - low) * (at - F.floor(at))
    out = x.groupBy("level").agg(F.avg((F.col("y") <= q).cast("int")).alias("covered"), F.count("*").alias("n"))
    return out.withColumn("error", (F.col("covered") - F.col("level")) ** 2)


def mixture_likelihood(samples: DataFrame, draws: str, actual: str, sigma: float) -> DataFrame:
    """samples with loglik, the log density of the actual value in the equal mixture of normals around a row's draws."""
    z = lambda v: -0.5 * F.pow((F.col(actual) - v) / sigma, F.lit(2))
    terms = F.transform(draws, z)
    top = F.array_max(terms)  # the largest term goes first, so that no term overflows and none that counts is lost
    total = F.aggregate(F.transform(draws, lambda v: F.exp(z(v) - top)), F.lit(0.0), lambda s, v: s + v)
    return samples.withColumn("loglik", F.when(F.size(draws) > 0, top + F.log(total / F.size(draws)) - F.log(F.lit(sigma)) - 0.9189385332046727))
