"""Row-level cleaning: parsing, clocks, fills, recodes, row filters, validated joins, and selections in order."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY
from .series import by_time, lerp
from .windows import cumulated



def two_formats(text: Column, first: str = "dd/MM/yyyy HH:mm", second: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """A timestamp in either format, null in neither."""
    return F.coalesce(F.try_to_timestamp(text, F.lit(first)), F.try_to_timestamp(text, F.lit(second)))


def rollover(df: DataFrame, clock: str, order: str) -> DataFrame:
    """Adds seconds, from the first row's midnight: a clock (seconds of the day) that doesn't advance begins another day,
    and so does one that stands still."""
    w = Window.partitionBy("id").orderBy(order)
    days = F.sum(F.when(F.col(clock) - F.lag(clock).over(w) <= 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("seconds", F.col(clock) + days * 86_400)


def day_and_clock(day: Column, clock: Column, anchor: int) -> Column:
    """Microseconds of day 1, 2, ... and a clock in microseconds; anchor is day 1."""
    return F.lit(anchor) + (day - 1) * DAY + clock


def fill_mean(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Nulls become their group's mean; it is aggregated and joined, so no group meets in one task."""
    mean = df.groupBy(*by).agg(F.avg(column).alias("_mean"))
    return df.join(mean, by, "left").withColumn(column, F.coalesce(column, "_mean")).drop("_mean")


def recode(column: Column, codes: dict) -> Column:
    """What codes maps it to, null if to nothing."""
    return F.create_map(*map(F.lit, chain(*codes.items())))[column]


def to_unit(value: Column, unit: Column, factors: dict[str, float]) -> Column:
    """value times its unit's factor; as it is in other units."""
    return value * F.coalesce(recode(unit, factors), F.lit(1.0))


def penalty_score(rules: list[tuple[Column, int]], start: int = 1000) -> Column:
    """start less the points of the rules that hold; null conditions cost nothing."""
    return sum((-F.when(rule, points).otherwise(0) for rule, points in rules), F.lit(start))


def linear_score(terms: list[tuple[Column, float]], intercept: float) -> Column:
    """Sigmoid of a frozen linear formula, its logit held to 40 either way."""
    z = sum((x * w for x, w in terms), F.lit(intercept))
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))


def forward_fill(df: DataFrame, column: str, order: str = "us") -> DataFrame:
    w = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.last(column, ignorenulls=True).over(w))


def drop_positions(df: DataFrame, order: str, positions: list[int], times: int = 2) -> DataFrame:
    """Drops each id's rows at these places, `times` over: numbers are taken anew in between, so the row that moved up to
    a place goes as well."""
    for _ in range(times):
        df = df.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order)) - 1).where(~F.col("_n").isin(positions)).drop("_n")
    return df


def one_gap_marker(df: DataFrame, keep: Column) -> DataFrame:
    """Rows that are kept, and of each stretch of others the first, with a null value."""
    x = df.withColumn("_k", keep)
    x = x.withColumn("_p", F.coalesce(F.lag("_k").over(by_time()), F.lit(True))).where("_k OR _p")
    return x.withColumn("v", F.when(F.col("_k"), F.col("v"))).drop("_k", "_p")


def continuous(df: DataFrame, n: int, span: int, gap: int) -> DataFrame:
    """(id, ok) of (id, date): whether there are exactly n dates, within span days, and gap days apart at most."""
    d = df.select("id", "date").distinct()
    d = d.withColumn("_gap", F.col("date") - F.lag("date").over(Window.partitionBy("id").orderBy("date")))
    return d.groupBy("id").agg(((F.count("*") == n) & (F.max("date") - F.min("date") <= span) & (F.coalesce(F.max("_gap"), F.lit(0)) <= gap)).alias("ok"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; fails when it runs if a key comes twice on either side. Each side is checked where the join puts it."""
    def checked(df: DataFrame, side: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        ok = F.when(n == 1, True).otherwise(F.raise_error(F.lit(f"a key of the {side} comes twice")).cast("boolean"))
        return df.withColumn("_ok", ok).where("_ok").drop("_ok")

    return checked(left, "left side").join(checked(right, "right side"), keys)


def first_rows(df: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """Of each id, each column's first value that isn't null."""
    rank = F.struct(*order)
    return df.groupBy("id").agg(*(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c) for c in columns))


def at_most(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group in order. Spark keeps n of each group in every part of the table before it shuffles
    (WindowGroupLimit), so a group with most of the rows is not sorted in one place."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def lowest_share(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """Of each id the first max(1, ceil(share n)) rows in order."""
    n = F.count("*").over(Window.partitionBy("id"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return df.withColumn("_n", rank).withColumn("_top", F.greatest(F.lit(1), F.ceil(F.lit(share) * n))).where("_n <= _top").drop("_n", "_top")


def every(df: DataFrame, k: int, offset: int = 0, order: str = "us") -> DataFrame:
    """Of each id the rows at offset, offset + k, ..."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(order)) - 1).where((F.col("_n") % k) == offset).drop("_n")


def onsets(df: DataFrame, order: str = "us") -> DataFrame:
    """Rows with a positive value after one that isn't, or after none."""
    before = F.coalesce(F.lag("v").over(Window.partitionBy("id").orderBy(order)), F.lit(0.0))
    return df.withColumn("_b", before).where("v > 0 AND _b <= 0").drop("_b")


def fill_by_row(df: DataFrame, order: str = "us") -> DataFrame:
    """Nulls between values become linear in the row's number, not in time; those outside stay."""
    w = Window.partitionBy("id").orderBy(order)
    x = df.withColumn("_n", F.row_number().over(w)).withColumn("_k", F.when(F.col("v").isNotNull(), F.col("_n")))
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    last, following = (lambda c: F.last(c, ignorenulls=True).over(back)), (lambda c: F.first(c, ignorenulls=True).over(ahead))
    x = x.select("*", last("_k").alias("_a"), last("v").alias("_av"), following("_k").alias("_z"), following("v").alias("_zv"))
    return x.withColumn("v", F.when(F.col("_a").isNotNull() & F.col("_z").isNotNull(), lerp(F.col("_a"), F.col("_av"), F.col("_z"), F.col("_zv"), F.col("_n")))).drop("_n", "_k", "_a", "_av", "_z", "_zv")


def core_distance(df: DataFrame, night: Column) -> DataFrame:
    """Distance of the median point of (v, next v) by night from that of all."""
    x = df.withColumn("y", F.lead("v").over(by_time())).withColumn("_night", night).where("v IS NOT NULL AND y IS NOT NULL")
    m = x.groupBy("id").agg(*(F.median(c).alias(c) for c in "vy"), *(F.median(F.when(F.col("_night"), F.col(c))).alias(f"n{c}") for c in "vy"))
    return m.select("id", F.sqrt(F.pow(F.col("v") - F.col("nv"), F.lit(2)) + F.pow(F.col("y") - F.col("ny"), F.lit(2))).alias("distance"))


def detrended_ar1(df: DataFrame, date: Column, least: int = 24, pairs: int = 20) -> DataFrame:
    """Sum of products of neighbouring residuals by that of their squares, over nights of `least` points, each less its own
    straight line; null under `pairs` pairs."""
    night = Window.partitionBy("id", "_d")
    x = df.where("v IS NOT NULL").withColumn("_d", date).withColumn("_x", (F.col("us") - F.min("us").over(night)) / DAY)
    x = x.withColumn("_n", F.count("*").over(night)).where(F.col("_n") >= least)
    r = F.col("v") - F.regr_intercept("v", "_x").over(night) - F.regr_slope("v", "_x").over(night) * F.col("_x")
    x = x.withColumn("_r", r).withColumn("_q", F.lag("_r").over(night.orderBy("us"))).where("_q IS NOT NULL")
    return x.groupBy("id").agg(F.when(F.count("*") >= pairs, F.sum(F.col("_q") * F.col("_r")) / F.sum(F.col("_q") * F.col("_q"))).alias("ar1"), F.count("*").alias("pairs"))


def median_split_auc(df: DataFrame, split: str, score: str) -> DataFrame:
    """U / (n1 n2) of score in rows whose split is over its median against the others, with the medians of both."""
    mid = df.agg(F.median(split).alias("_m"))  # one row
    x = df.crossJoin(F.broadcast(mid)).withColumn("_high", (F.col(split) > F.col("_m")).cast("long"))
    c = x.groupBy(score).agg(F.sum("_high").alias("p"), F.sum(1 - F.col("_high")).alias("n"))
    u = cumulated(c, score, ["n"]).withColumn("u", F.col("p") * (F.col("below_n") + F.col("n") / 2)).agg((F.sum("u") / (F.sum("p") * F.sum("n"))).alias("auc"))
    both = x.agg(F.median(F.when(F.col("_high") == 1, F.col(score))).alias("high"), F.median(F.when(F.col("_high") == 0, F.col(score))).alias("low"))
    return u.crossJoin(F.broadcast(both))


#: Logit of the night mean, and the tiers' limits.
NIGHT_SLOPE, NIGHT_INTERCEPT, TIERS = 1.064314, -6.746364, (0.30, 0.50)


def night_risk(night: Column) -> Column:
    return linear_score([(night, NIGHT_SLOPE)], NIGHT_INTERCEPT)


def curve_at_minutes(df: DataFrame) -> DataFrame:
    """(id, minute, v) of sparse (id, minute, v): each whole minute between an id's points, linear."""
    w = Window.partitionBy("id").orderBy("minute")
    x = df.withColumn("_m", F.lead("minute").over(w)).withColumn("_v", F.lead("v").over(w))
    stop = F.when(F.col("_m").isNull(), F.col("minute")).otherwise(F.col("_m") - 1)
    x = x.withColumn("_t", F.explode(F.sequence("minute", stop)))
    return x.select("id", F.col("_t").alias("minute"), F.when(F.col("_m").isNull(), F.col("v")).otherwise(lerp(F.col("minute"), F.col("v"), F.col("_m"), F.col("_v"), F.col("_t"))).alias("v"))


