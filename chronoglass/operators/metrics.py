"""Per-id metrics of gridded readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY, HOUR, day_of
from .series import by_time, period

# Identifier, unit and definition of the metrics.
CATALOGUE = [
    ("mean", "mmol/L", "mean of valid points"), ("night_mean", "mmol/L", "mean of 0-6 h"), ("sd", "mmol/L", "sample deviation"), ("cv", "%", "100 sd / mean"), ("tir", "%", "share in 70-180 mg/dL"),
    ("tar180", "%", "share over 180 mg/dL"), ("tar250", "%", "share over 250 mg/dL"), ("tbr70", "%", "share under 70 mg/dL"), ("tbr54", "%", "share under 54 mg/dL"), ("gmi", "%", "3.31 + 0.02392 mean in mg/dL"),
    ("rate_mean_abs", "mmol/L/h", "mean absolute step per hour"), ("rate_p95_up", "mmol/L/h", "95th percentile of rises"), ("rate_p95_down", "mmol/L/h", "95th percentile of falls"), ("slope_day", "mmol/L/day", "least-squares slope"),
    ("valid_points", "", "valid grid points"), ("span_hours", "h", "first to last point"), ("coverage", "", "valid part of the grid"), ("eligible", "", "span and coverage suffice"),
]


def metric_row(grid: DataFrame, minutes: int, span: float = 24, cover: float = 0.7, gmi_days: float = 14) -> DataFrame:
    """One row per id; thresholds are mg/dL over 18, as the metrics' definitions have them."""
    step = F.when((F.col("us") - F.lag("us").over(by_time())) == minutes * 60_000_000, (F.col("v") - F.lag("v").over(by_time())) * 60 / minutes)
    x, v = grid.withColumn("rate", step), F.col("v")
    share = lambda c: 100 * F.avg(F.when(v.isNotNull(), c.cast("double")))
    days = (F.col("us") / F.lit(float(DAY))) - 19723  # near zero, so that sums keep their digits
    out = x.groupBy("id").agg(
        F.avg("v").alias("mean"), F.avg(F.when(period(F.col("us"), 0, 6), v)).alias("night_mean"), F.stddev_samp("v").alias("sd"), share((v >= 70 / 18) & (v <= 180 / 18)).alias("tir"),
        share(v > 180 / 18).alias("tar180"), share(v > 250 / 18).alias("tar250"), share(v < 70 / 18).alias("tbr70"), share(v < 54 / 18).alias("tbr54"), F.avg(F.abs("rate")).alias("rate_mean_abs"),
        F.percentile(F.when(F.col("rate") > 0, F.col("rate")), 0.95).alias("rate_p95_up"), F.percentile(F.when(F.col("rate") < 0, -F.col("rate")), 0.95).alias("rate_p95_down"),
        F.regr_slope(v, days).alias("slope_day"), F.count("v").alias("valid_points"), ((F.max("us") - F.min("us")) / HOUR).alias("span_hours"), (F.count("v") / F.count("*")).alias("coverage"),
    )
    gmi = F.when((F.col("span_hours") >= 24 * gmi_days) & (F.col("coverage") >= cover), 3.31 + 0.02392 * F.col("mean") * 18)
    return out.withColumn("cv", 100 * F.col("sd") / F.col("mean")).withColumn("gmi", gmi).withColumn("eligible", (F.col("span_hours") >= span) & (F.col("coverage") >= cover))


def risk(v: Column) -> Column:
    """Symmetrised scale of a value in mmol/L."""
    return 1.509 * (F.pow(F.log(v * 18), F.lit(1.084)) - 5.381)


def standard_row(df: DataFrame) -> DataFrame:
    """J-index, low and high risk over their own subset, dawn difference, range."""
    v, f = F.col("v"), risk(F.greatest(F.col("v"), F.lit(0.1)))
    dawn = F.avg(F.when(period(F.col("us"), 4, 8), v)) - F.avg(F.when(period(F.col("us"), 0, 4), v))
    return df.groupBy("id").agg(
        (0.001 * F.pow(18 * (F.avg("v") + F.stddev_samp("v")), F.lit(2))).alias("j_index"), F.avg(F.when(f < 0, 10 * f * f)).alias("lbgi"), F.avg(F.when(f > 0, 10 * f * f)).alias("hbgi"),
        dawn.alias("dawn"), F.min("v").alias("low"), F.max("v").alias("high"), (F.max("v") - F.min("v")).alias("spread"),
    )


def modd(grid: DataFrame, steps: int, least: int) -> DataFrame:
    """Mean absolute difference of points `steps` apart on the full grid, if there are enough pairs."""
    d = F.abs(F.lead("v", steps).over(by_time()) - F.col("v"))
    return grid.withColumn("d", d).groupBy("id").agg(F.when(F.count("d") >= least, F.avg("d")).alias("modd"))


def mage(df: DataFrame) -> DataFrame:
    """Mean step between smoothed extremes of at least one deviation."""
    s = F.avg("v").over(by_time().rowsBetween(-1, 1))
    x = df.where("v IS NOT NULL").withColumn("s", s)
    a, z = F.col("s") - F.lag("s").over(by_time()), F.lead("s").over(by_time()) - F.col("s")
    ends = x.withColumn("turn", a * z).where("turn < 0")
    steps = ends.withColumn("d", F.abs(F.col("s") - F.lag("s").over(by_time())))
    sd = x.groupBy("id").agg(F.stddev_samp("v").alias("sd"))
    return steps.join(sd, "id").where("d >= sd").groupBy("id").agg(F.avg("d").alias("mage"), F.count("*").alias("n"))


def burden(df: DataFrame, low: float = 3.9, high: float = 10.0) -> DataFrame:
    v = F.col("v")
    return df.groupBy("id").agg(F.avg(F.greatest(v - high, F.lit(0.0))).alias("hyper"), F.avg(F.greatest(low - v, F.lit(0.0))).alias("hypo"), F.greatest(F.stddev_pop("v") / F.avg("v") - 0.15, F.lit(0.0)).alias("load"))


def window_stats(df: DataFrame) -> DataFrame:
    v = F.col("v")
    return df.groupBy("id").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.stddev_pop("v") / F.avg("v")).alias("cv"), (100 * F.avg(((v < 3.9) | (v > 10.0)).cast("double"))).alias("out_of_range"),
        (F.percentile("v", 0.95) - F.percentile("v", 0.05)).alias("spread90"),
    )


def robust(df: DataFrame, by: list[str]) -> DataFrame:
    """Median and scale: 1.4826 MAD, else IQR / 1.349, else deviation, else 1."""
    m = df.groupBy(*by).agg(F.median("v").alias("centre"), F.percentile("v", 0.25).alias("q1"), F.percentile("v", 0.75).alias("q3"), F.stddev_samp("v").alias("sd"))
    mad = df.join(m, by).groupBy(*by).agg(F.median(F.abs(F.col("v") - F.col("centre"))).alias("mad"))
    pos = lambda c: F.when(c > 1e-12, c)
    return m.join(mad, by).select(*by, "centre", "mad", F.coalesce(pos(1.4826 * F.col("mad")), pos((F.col("q3") - F.col("q1")) / 1.349), pos(F.col("sd")), F.lit(1.0)).alias("scale"))


def day_nights(df: DataFrame) -> DataFrame:
    """(id, date): early and late night means, dawn difference, quartile distance."""
    us, v = F.col("us"), F.col("v")
    early, late, dawn = (F.avg(F.when(period(us, a, b), v)) for a, b in ((0, 3), (3, 6), (6, 9)))
    return df.groupBy("id", day_of(us).alias("date")).agg(early.alias("early"), late.alias("late"), (dawn - late).alias("dawn"), (F.percentile("v", 0.75) - F.percentile("v", 0.25)).alias("iqr"))


def trapezoid(df: DataFrame) -> DataFrame:
    """Integral over hours between neighbours."""
    w = Window.partitionBy("id").orderBy("us")
    area = (F.col("v") + F.lead("v").over(w)) / 2 * (F.lead("us").over(w) - F.col("us")) / HOUR
    return df.withColumn("a", area).groupBy("id").agg(F.sum("a").alias("area"))


def night_slowing(df: DataFrame, least: int) -> DataFrame:
    """Median over nights of lag-1 autocorrelation, variance and skewness of 0-6 h readings; nights of one value have only the variance."""
    x = df.where(period(F.col("us"), 0, 6)).withColumn("date", day_of(F.col("us")))
    w = Window.partitionBy("id", "date").orderBy("us")
    x = x.withColumn("m", F.avg("v").over(Window.partitionBy("id", "date"))).withColumn("c", F.col("v") - F.col("m"))
    x = x.withColumn("p", F.col("c") * F.lag("c").over(w))
    some = lambda c: F.nullif(c, F.lit(0.0))
    n = x.groupBy("id", "date").agg(F.count("*").alias("n"), (F.sum("p") / some(F.sum(F.col("c") * F.col("c")))).alias("ar1"), F.var_samp("v").alias("var"), (F.avg(F.pow("c", F.lit(3))) / some(F.pow(F.var_samp("v"), F.lit(1.5)))).alias("skew"))
    return n.where(F.col("n") >= least).groupBy("id").agg(F.median("ar1").alias("ar1"), F.median("var").alias("var"), F.median("skew").alias("skew"), F.count("*").alias("nights"))
