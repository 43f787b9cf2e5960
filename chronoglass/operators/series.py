"""Cleaning, segments, grids, splits and samples."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY, HOUR, MINUTE, day_of, nearest_minute


def by_time() -> Window:
    """A function, as workers import this module without a session."""
    return Window.partitionBy("id").orderBy("us")


def mean_in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, v): means of v, added up by `order`, so that their last bits don't depend on where rows lie."""
    w = Window.partitionBy(*keys).orderBy(order)
    x = df.select(*keys, F.avg("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead(F.lit(1)).over(w).alias("_next"))
    return x.where("_next IS NULL").drop("_next")


def collapse(df: DataFrame, order: str | None = None) -> DataFrame:
    """One reading per id and minute, the mean, added up by `order` if there is one."""
    x = df.withColumn("us", nearest_minute(F.col("us")))
    return mean_in_order(x, ["id", "us"], order) if order else x.groupBy("id", "us").agg(F.avg("v").alias("v"))


def keep_one(df: DataFrame, order: str, last: bool = True) -> DataFrame:
    """Of readings with the same id and time, the last or first by an ingest ordinal."""
    w = Window.partitionBy("id", "us").orderBy(F.desc(order) if last else F.asc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def segments(df: DataFrame, gap: int, min_rows: int = 1) -> DataFrame:
    """Adds seg, from 0 per id: a gap of more than `gap` whole minutes begins a new one. Segments under min_rows go."""
    step = F.floor((F.col("us") - F.lag("us").over(by_time())) / MINUTE)
    out = df.withColumn("_new", F.when(step > gap, 1).otherwise(0)).withColumn("seg", F.sum("_new").over(by_time().rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return out.withColumn("_n", F.count("*").over(Window.partitionBy("id", "seg"))).where(F.col("_n") >= min_rows).drop("_n")


def renumber(df: DataFrame) -> DataFrame:
    """Adds sid: segments in order of (id, seg). Ids' segment counts are prefix-summed, one row per id, not all segments."""
    own = df.withColumn("_k", F.dense_rank().over(Window.partitionBy("id").orderBy("seg")))
    counts = own.groupBy("id").agg(F.max("_k").alias("_segs"))
    base = counts.select("id", (F.sum("_segs").over(Window.orderBy("id")) - F.col("_segs")).alias("_base"))
    return own.join(base, "id").withColumn("sid", F.col("_base") + F.col("_k") - 1).drop("_k", "_base")


def lerp(t0: Column, v0: Column, t1: Column, v1: Column, t: Column) -> Column:
    return F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))


def interpolate(df: DataFrame, interval: int) -> DataFrame:
    """(id, seg, us, v): each segment on a grid from its first reading, linear in time between its readings."""
    step = interval * MINUTE
    keys = Window.partitionBy("id", "seg").orderBy("us")
    pairs = df.select("id", "seg", "us", "v", F.min("us").over(Window.partitionBy("id", "seg")).alias("t0"), F.lead("us").over(keys).alias("us1"), F.lead("v").over(keys).alias("v1"))
    first = F.ceil((F.col("us") - F.col("t0")) / step).cast("long")
    last = F.when(F.col("us1").isNull(), F.floor((F.col("us") - F.col("t0")) / step)).otherwise(F.ceil((F.col("us1") - F.col("t0")) / step) - 1).cast("long")
    pairs = pairs.withColumn("_a", first).withColumn("_z", last).where("_z >= _a")
    grid = pairs.select("*", F.explode(F.sequence("_a", "_z")).alias("_k")).withColumn("g", F.col("t0") + F.col("_k") * step)
    return grid.select("id", "seg", F.col("g").alias("us"), F.when(F.col("us1").isNull(), F.col("v")).otherwise(lerp(F.col("us"), F.col("v"), F.col("us1"), F.col("v1"), F.col("g"))).alias("v"))


def densify(df: DataFrame, fine: int, short: int, long: int) -> DataFrame:
    """Between readings more than `short` and at most `long` minutes apart, round(gap / fine) equal steps, half to even;
    after a longer gap begins, one null at `long` minutes; shorter gaps stay."""
    w = df.select("id", "us", "v", F.lead("us").over(by_time()).alias("us1"), F.lead("v").over(by_time()).alias("v1"))
    gap = (F.col("us1") - F.col("us")) / MINUTE
    steps = F.bround(gap / fine).cast("long")
    inner = w.where((gap > short) & (gap <= long) & F.col("v").isNotNull() & F.col("v1").isNotNull()).withColumn("n", steps).where("n > 1")
    inner = inner.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("k"))
    inner = inner.select("id", F.floor(F.col("us") + (F.col("us1") - F.col("us")) * F.col("k") / F.col("n")).alias("us"), (F.col("v") + (F.col("v1") - F.col("v")) * F.col("k") / F.col("n")).alias("v"))
    marks = w.where(gap > long).select("id", (F.col("us") + long * MINUTE).alias("us"), F.lit(None).cast("double").alias("v"))
    return df.select("id", "us", "v").unionByName(inner).unionByName(marks)


def regularize(df: DataFrame, grid: int, gap: int) -> DataFrame:
    """(id, us, v) on a clock-aligned grid of `grid` minutes from each id's floor to its ceiling; null inside gaps longer
    than `gap` minutes. A lone reading goes to its nearest point if that is at most half a step away."""
    step = grid * MINUTE
    s = segments(df.where("v IS NOT NULL"), gap)
    k = Window.partitionBy("id", "seg").orderBy("us")
    pairs = s.select("id", "us", "v", F.lead("us").over(k).alias("us1"), F.lead("v").over(k).alias("v1"), F.count("*").over(Window.partitionBy("id", "seg")).alias("n"), F.row_number().over(k).alias("i"))
    lone = pairs.where("n = 1").select("id", (F.bround(F.col("us") / step) * step).cast("long").alias("us"), "v")
    ins = pairs.where("us1 IS NOT NULL").withColumn("a", F.ceil(F.col("us") / step)).withColumn("z", F.when(F.col("i") == F.col("n") - 1, F.floor(F.col("us1") / step)).otherwise(F.ceil(F.col("us1") / step) - 1)).where("z >= a")
    ins = ins.select("*", F.explode(F.sequence("a", "z")).alias("j")).withColumn("g", F.col("j") * step)
    filled = ins.select("id", F.col("g").alias("us"), lerp(F.col("us"), F.col("v"), F.col("us1"), F.col("v1"), F.col("g")).alias("v")).unionByName(lone)
    filled = filled.groupBy("id", "us").agg(F.avg("v").alias("v"))
    ends = df.groupBy("id").agg(F.floor(F.min("us") / step).alias("a"), F.ceil(F.max("us") / step).alias("z"))
    return ends.select("id", F.explode(F.sequence("a", "z")).alias("j")).select("id", (F.col("j") * step).alias("us")).join(filled, ["id", "us"], "left")


def ood_ids(df: DataFrame, share: float, seed: int) -> DataFrame:
    """ceil(n x share) ids, the first by SHA-256 of id and seed: a top-k, never a sort of all rows in one task."""
    ids = df.select("id").distinct().withColumn("h", F.sha2(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))), 256))
    n = ids.count()
    return ids.orderBy("h").limit(math.ceil(Fraction(str(share)) * n)).select("id")


def split(grid: DataFrame, history: int, length: int) -> DataFrame:
    """Rows of (id, seg, us, ...) with `part` in train, val, test: the last segments of an id are cut by their length."""
    m, n = history, length
    pos = grid.withColumn("r", F.row_number().over(Window.partitionBy("id", "seg").orderBy(F.desc("us"))))  # from the end, 1
    pos = pos.withColumn("n", F.count("*").over(Window.partitionBy("id", "seg"))).withColumn("back", F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("seg"))))
    ends = pos.groupBy("id").agg(F.max("back").alias("segs"), F.max(F.when(F.col("back") == 1, F.col("n"))).alias("n1"), F.max(F.when(F.col("back") == 2, F.col("n"))).alias("n2"))
    x = pos.join(ends, "id")
    r, back, n1, n2, one = F.col("r"), F.col("back"), F.col("n1"), F.col("n2"), F.col("segs") == 1
    full, some = n1 >= m + 3 * n, (n1 >= m + 2 * n) & (n1 < m + 3 * n)
    short, lent = n1 < m + 2 * n, n2 >= m + 2 * n
    last, prev = back == 1, back == 2
    train = (back > 2) | (prev & ((full | some) | (short & ~lent) | (short & lent & (r > n)))) | (last & full & (r > 2 * n)) | (last & one & ((some & (r > n)) | short))
    val = (last & full & (r > n) & (r <= 2 * n + m)) | (last & some & ~one & (r > n)) | (prev & short & lent & (r <= n + m))
    test = (last & (full | some) & (r <= n + m)) | (last & short & ~one)
    parts = F.array_compact(F.array(F.when(train, "train"), F.when(val, "val"), F.when(test, "test")))
    return x.select(*grid.columns, F.explode(parts).alias("part"))


def samples(grid: DataFrame, past: int, future: int) -> DataFrame:
    """(id, seg, us, past, future): every place of a segment with enough rows."""
    w = Window.partitionBy("id", "seg").orderBy("us")
    x = grid.select("id", "seg", "us", F.collect_list("v").over(w.rowsBetween(0, past - 1)).alias("past"), F.collect_list("v").over(w.rowsBetween(past, past + future - 1)).alias("future"))
    return x.where((F.size("past") == past) & (F.size("future") == future))


def lags(df: DataFrame, ks: list[int], by: tuple = ("id",)) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("us")
    return df.select("*", *(F.lag("v", k).over(w).alias(f"lag{k}") for k in ks))


def encode(df: DataFrame, column: str) -> DataFrame:
    """Categories as 0, 1, ... by name; one row per category meets the rest."""
    codes = df.select(column).distinct().withColumn("code", (F.dense_rank().over(Window.orderBy(column)) - 1).cast("double"))
    return df.join(codes, column)


def scaled(df: DataFrame, train: DataFrame, column: str = "v", kind: str = "minmax") -> DataFrame:
    """Fitted on train, applied to df."""
    fit = train.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"), F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    one = {"minmax": (F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")), "standard": (F.col(column) - F.col("_m")) / F.col("_s")}[kind]
    return df.crossJoin(F.broadcast(fit)).withColumn("scaled", one).drop("_lo", "_hi", "_m", "_s")


def period(us: Column, start: int, stop: int) -> Column:
    """Whether the clock is in [start, stop) hours."""
    h = F.pmod(us, F.lit(DAY)) / HOUR
    return (h >= start) & (h < stop)


def qualified_days(df: DataFrame, night: int, day: int) -> DataFrame:
    """(id, date) with enough readings by night (0-6 h) and by day (6-22 h)."""
    x = df.where("v IS NOT NULL").groupBy("id", day_of(F.col("us")).alias("date")).agg(F.count_if(period(F.col("us"), 0, 6)).alias("n_night"), F.count_if(period(F.col("us"), 6, 22)).alias("n_day"))
    return x.where((F.col("n_night") >= night) & (F.col("n_day") >= day))
