"""Excursions, challenges and responses: what happens around peaks and events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import MINUTE
from .joins import within
from .series import by_time
from .windows import turning_points


def excursions(df: DataFrame, rise: float = 1.5, least: int = 3) -> DataFrame:
    """(id, peak, amplitude, early, relax, crossing, tau, r2): a row per peak that is `rise` or more over the valley before it.

    Times are minutes. early: from the valley to the steepest step up; relax: from the peak to the first reading half-way
    down, or one and a half times the way to the next valley if there is none; crossing: where the line between readings
    crosses half-way, null if it doesn't; tau, r2: decay constant and fit of the log distance to the valley, null under
    `least` readings or if it doesn't fall. The first reading and the last stand in for missing valleys. Each reading
    goes to the one or two valleys it lies between by windows, so no id is joined to itself.
    """
    turns = turning_points(df).select("id", "us", "kind")
    x = df.join(turns, ["id", "us"], "left").withColumn("dv", F.lead("v").over(by_time()) - F.col("v"))
    x = x.withColumn("us_", F.lag("us").over(by_time())).withColumn("v_", F.lag("v").over(by_time()))
    valley = F.when(F.col("kind") == "valley", F.col("us"))
    start = F.min("us").over(Window.partitionBy("id"))
    here = F.coalesce(F.max(valley).over(by_time()), start)
    before = F.coalesce(F.max(valley).over(by_time().rowsBetween(Window.unboundedPreceding, -1)), start)
    keys = F.when((F.col("kind") == "valley") & (before < F.col("us")), F.array(here, before)).otherwise(F.array(here))
    x = x.withColumn("keys", keys).select("id", "us", "v", "kind", "dv", "us_", "v_", F.explode("keys").alias("a"))
    part = Window.partitionBy("id", "a")
    x = x.withColumn("p", F.max(F.when(F.col("kind") == "peak", F.col("us"))).over(part))
    x = x.withColumn("pv", F.max(F.when(F.col("kind") == "peak", F.col("v"))).over(part)).withColumn("av", F.min_by("v", "us").over(part))
    x = x.where(F.col("pv") - F.col("av") >= rise)
    target, down = F.col("pv") - 0.5 * (F.col("pv") - F.col("av")), F.col("us") >= F.col("p")
    x = x.withColumn("stop", F.min(F.when(down & (F.col("v") <= F.col("av")), F.col("us"))).over(part))
    x = x.withColumn("half", F.min(F.when(down & (F.col("v") <= target), F.col("us"))).over(part))
    minutes = (F.col("us") - F.col("p")) / float(MINUTE)
    fit = down & (F.col("stop").isNull() | (F.col("us") < F.col("stop"))) & (F.col("v") > F.col("av"))
    y, t = F.when(fit, F.log(F.col("v") - F.col("av"))), F.when(fit, minutes)
    cross = F.when(F.col("us") == F.col("half"), (F.col("us_") + (F.col("v_") - target) / (F.col("v_") - F.col("v")) * (F.col("us") - F.col("us_")) - F.col("p")) / float(MINUTE))
    climbing = F.col("us") < F.col("p")
    out = x.groupBy("id", "a", "p").agg(
        F.max(F.col("pv") - F.col("av")).alias("amplitude"),
        (F.max_by(F.when(climbing, F.col("us")), F.when(climbing, F.struct("dv", -F.col("us")))) - F.col("a")).alias("early"),
        F.coalesce(F.max("half") - F.col("p"), (F.max("us") - F.col("p")) * 1.5).alias("relax"),
        F.max(cross).alias("crossing"), F.regr_slope(y, t).alias("slope"), F.regr_r2(y, t).alias("r2"), F.count(y).alias("n"),
    )
    good = (F.col("n") >= least) & (F.col("slope") < 0)
    return out.select("id", F.col("p").alias("peak"), "amplitude", (F.col("early") / MINUTE).alias("early"), (F.col("relax") / MINUTE).alias("relax"), "crossing", F.when(good, -1 / F.col("slope")).alias("tau"), F.when(good, F.col("r2")).alias("r2"))


def excursion_summary(found: DataFrame) -> DataFrame:
    """Medians per id, the number of excursions and of those that were fitted."""
    return found.groupBy("id").agg(*(F.median(c).alias(c) for c in ("amplitude", "early", "relax", "crossing", "tau")), F.count("*").alias("n"), F.count("tau").alias("fitted"))


def challenges(events: DataFrame, readings: DataFrame, dose: str, unit: int, before: int = 30, into: int = 10, peak: int = 180, after: int = 240, rise: float = 0.2, most: float = 0.2, floor: float = 0.5) -> DataFrame:
    """(id, ev, base, delta, slope, strain, relax, work, specific): the response to each event of a dose.

    Times are counted in `unit` microseconds. base: least reading from `before` ahead to `into` after the event; the peak
    is the first highest until `peak`; relax: from the peak to the first reading within max(floor, most * delta) of the
    base, or to the last reading until `after`; work: area over the base. Events with a rise of at most `rise` go.
    """
    x = within(events, readings, before * unit, after * unit).withColumn("m", (F.col("us") - F.col("at")) / float(unit))
    ev = Window.partitionBy("id", "ev")
    x = x.withColumn("base", F.min(F.when(F.col("m") <= into, F.col("v"))).over(ev))
    top = F.when(F.col("m").between(0, peak), F.struct(F.col("v").alias("v"), (-F.col("m")).alias("m")))
    x = x.withColumn("top", F.max(top).over(ev)).withColumn("delta", F.col("top.v") - F.col("base")).where(F.col("delta") > rise)
    near = F.col("base") + F.greatest(F.lit(floor), F.lit(most) * F.col("delta"))
    above = F.when(F.col("m") >= 0, F.greatest(F.col("v") - F.col("base"), F.lit(0.0)))
    step = ev.orderBy("us")
    area = (above + F.lag(above).over(step)) / 2 * (F.col("m") - F.lag("m").over(step))
    x = x.withColumn("area", area).withColumn("tm", -F.col("top.m"))
    out = x.groupBy("id", "ev", dose).agg(
        F.first("base").alias("base"), F.first("delta").alias("delta"), F.first("tm").alias("tm"),
        F.coalesce(F.min(F.when((F.col("m") >= F.col("tm")) & (F.col("v") <= near), F.col("m"))), F.max("m")).alias("until"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("work"),
    )
    return out.select("id", "ev", "base", "delta", (F.col("delta") / F.greatest(F.lit(1.0), "tm")).alias("slope"), (F.col("delta") / F.col(dose)).alias("strain"), (F.col("until") - F.col("tm")).alias("relax"), "work", (F.col("work") / F.col(dose)).alias("specific"))


def curves(df: DataFrame, least: int = 5) -> DataFrame:
    """(id, base, peak, to_peak, area, residual, recovered) of response curves (id, t, v), t from the challenge on.

    base: mean up to time 0, else of the first two points; the rest is over points from 0 on, of which `least` are needed.
    """
    w = Window.partitionBy("id")
    x = df.where(F.col("t").isNotNull() & F.col("v").isNotNull()).withColumn("k", F.row_number().over(w.orderBy("t")))
    x = x.withColumn("base", F.coalesce(F.avg(F.when(F.col("t") <= 0, F.col("v"))).over(w), F.avg(F.when(F.col("k") <= 2, F.col("v"))).over(w))).where("t >= 0")
    over = F.greatest(F.col("v") - F.col("base"), F.lit(0.0))
    x = x.withColumn("part", (over + F.lag(over).over(w.orderBy("t"))) / 2 * (F.col("t") - F.lag("t").over(w.orderBy("t"))))
    out = x.groupBy("id").agg(F.first("base").alias("base"), F.max(F.struct("v", -F.col("t"))).alias("top"), F.sum("part").alias("area"), F.max_by("v", "t").alias("last"), F.count("*").alias("n"), F.min_by("t", F.struct(-F.col("v"), F.col("t"))).alias("to_peak")).where(F.col("n") >= least)
    peak, residual = F.col("top.v") - F.col("base"), F.col("last") - F.col("base")
    return out.select("id", "base", peak.alias("peak"), "to_peak", "area", residual.alias("residual"), F.when(peak > 1e-8, (peak - residual) / peak).alias("recovered"))


def envelope(pairs: DataFrame, least: int = 3, narrow: float = 0.3, wide: float = 1.5, runs: int = 3) -> DataFrame:
    """(id, ev, centre, band, away, back): pairs (id, ev, at, us, v) of an event and the readings around it.

    The band is `wide` times the larger of `narrow` and 1.4826 MAD about the median before the event; back is when the
    first of `runs` readings in a row after the event lies in the band, in minutes; away is the envelope's area, the distances beyond it summed over the readings.
    """
    ev, pre = Window.partitionBy("id", "ev"), F.col("us") < F.col("at")
    x = pairs.withColumn("centre", F.median(F.when(pre, F.col("v"))).over(ev)).withColumn("n", F.count(F.when(pre, F.col("v"))).over(ev)).where(F.col("n") >= least)
    x = x.withColumn("d", F.abs(F.col("v") - F.col("centre"))).withColumn("band", wide * F.greatest(F.lit(narrow), 1.4826 * F.median(F.when(pre, F.col("d"))).over(ev))).where(~pre)
    inside: Column = F.col("d") <= F.col("band")
    ahead = [F.coalesce(F.lead(inside, k).over(ev.orderBy("us")), F.lit(False)) for k in range(1, runs)]
    for k in ahead:
        inside = inside & k
    x = x.withColumn("home", inside)
    return x.groupBy("id", "ev").agg(F.first("centre").alias("centre"), F.first("band").alias("band"), F.sum(F.greatest(F.col("d") - F.col("band"), F.lit(0.0))).alias("away"), F.min(F.when(F.col("home"), (F.col("us") - F.col("at")) / float(MINUTE))).alias("back"))


def rises(pdf: pd.DataFrame, step: int, trigger: float, above: float, least: float, look: int, calm: int, climb: int, settle: int, rest: int) -> pd.DataFrame:
    """Rises of one id's grid, found from what came before each point; times in steps. A rise begins `rest` after the last.

    A point begins one if it is `trigger` over the value `look` ago and `above` over the median of the `calm` before, of
    which four fifths must be known; its peak, within `climb`, must be `least` over that median. It has recovered when a
    quarter hour lies within a quarter of the amplitude of the median, `settle` after the peak at the latest.
    """
    v = pdf.sort_values("us")["v"].to_numpy(float)
    us = pdf["us"].sort_values().to_numpy()
    hour, out, free = us // (60 * MINUTE) % 24, [], 0
    block = max(1, 15 // step)
    for i in range(max(calm, look), len(v) - climb - settle):
        past, future = v[i - calm : i], v[i : i + climb + 1]
        if i < free or not 6 <= hour[i] < 22 or np.isnan(v[i]) or np.isnan(v[i - look]) or np.mean(~np.isnan(past)) < 0.8 or np.mean(~np.isnan(future)) < 0.8:
            continue
        base = float(np.nanmedian(past))
        if v[i] - v[i - look] < trigger or v[i] - base < above:
            continue
        to_peak = int(np.nanargmax(future))
        amplitude = float(future[to_peak]) - base
        if amplitude < least:
            continue
        tail, limit = v[i + to_peak : i + to_peak + settle + 1], base + 0.25 * amplitude
        calmed = np.convolve(tail <= limit, np.ones(block), "valid") == block
        took = int(calmed.argmax()) if calmed.any() else settle
        over = np.maximum(np.nan_to_num(tail, nan=limit) - limit, 0)
        debt = float(((over[1:] + over[:-1]) / 2).sum() * step / max(amplitude, 1e-6))
        out.append((pdf["id"].iloc[0], int(us[i]), base, amplitude, max(1, to_peak) * step, took * step, bool(calmed.any()), debt))
        free = i + rest
    return pd.DataFrame(out, columns=["id", "us", "base", "amplitude", "to_peak", "recovery", "recovered", "debt"])


def rise_rows(grid: DataFrame, step: int, trigger: float = 0.30, above: float = 0.25, least: float = 0.80, look: int = 15, calm: int = 30, climb: int = 120, settle: int = 180, rest: int = 120) -> DataFrame:
    """rises() per id on a grid of `step` minutes; spans in minutes. An id's readings meet in one task, as each rise
    depends on the one before."""
    in_steps = [max(1, look // step), max(2, calm // step), max(1, climb // step), max(1, settle // step), max(1, rest // step)]
    kinds = "id long, us long, base double, amplitude double, to_peak long, recovery long, recovered boolean, debt double"
    return grid.select("id", "us", "v").groupBy("id").applyInPandas(lambda pdf: rises(pdf, step, trigger, above, least, *in_steps), kinds)
