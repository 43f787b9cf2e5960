"""Nearest-time, interval and calendar joins; each is an equi-join on id and a time bucket, so no id meets itself whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import DAY


def _buckets(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))


def within(events: DataFrame, readings: DataFrame, before: int, after: int) -> DataFrame:
    """Pairs of an event (id, ev, at, ...) and a reading (id, us, v) with us in [at - before, at + after]. Events are laid
    in the few buckets of that length that they reach, so a pair is looked for in one bucket."""
    width = before + after + 1
    e = events.withColumn("_b", _buckets(F.col("at") - before, F.col("at") + after, width))
    r = readings.withColumn("_b", F.floor(F.col("us") / width))
    return e.join(r, ["id", "_b"]).where(F.col("us").between(F.col("at") - before, F.col("at") + after)).drop("_b")


def nearest(events: DataFrame, readings: DataFrame, tolerance: int) -> DataFrame:
    """The nearest reading of each event within tolerance, the earlier on ties."""
    pairs = within(events, readings, tolerance, tolerance)
    best = F.min_by(F.struct("us", "v"), F.struct(F.abs(F.col("us") - F.col("at")), F.col("us")))
    return pairs.groupBy("id", "ev", "at").agg(best.alias("x")).select("id", "ev", "at", "x.us", "x.v")


def matched(left: DataFrame, right: DataFrame, before: int, after: int) -> DataFrame:
    """Events of left with an event of right in the window."""
    pairs = within(left, right.select("id", F.col("at").alias("us")), before, after)
    return left.join(pairs.select("id", "ev").distinct(), ["id", "ev"], "left_semi")


def own_bins(df: DataFrame, start: DataFrame, days: int) -> DataFrame:
    """Adds bin: whole periods of `days` since the id's start (id, t0)."""
    return df.join(start, "id").withColumn("bin", F.floor((F.col("us") - F.col("t0")) / (days * DAY))).drop("t0")


def first_source(df: DataFrame, source: str, priority: list[str], least: int) -> DataFrame:
    """Rows of each id's first source by priority with enough rows."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    n = df.groupBy("id", source).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (rank > 0))
    best = n.groupBy("id").agg(F.min_by(source, rank).alias(source))
    return df.join(best, ["id", source], "left_semi")


def isolated(events: DataFrame, apart: int) -> DataFrame:
    """Events with no other event of the id closer than `apart`."""
    w = Window.partitionBy("id").orderBy("at", "ev")
    a, z = F.col("at") - F.lag("at").over(w), F.lead("at").over(w) - F.col("at")
    return events.withColumn("_ok", (F.coalesce(a, F.lit(apart)) >= apart) & (F.coalesce(z, F.lit(apart)) >= apart)).where("_ok").drop("_ok")
