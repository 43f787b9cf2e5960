"""Night windows, grids, ranks in two levels, folds and shuffles, against pandas and plain loops at the survey's constants."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronoglass.operators import nights, resampling, stats, windows

DAY0 = 1_767_225_600_000_000  # 2026-01-01
FIVE = 300_000_000


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(4)
    out = {}
    for i in range(4):
        n = 288 * 7
        v = 6 + 1.5 * np.sin(np.arange(n) / 40 + i) + np.cumsum(rng.normal(0, 0.08, n)) / 4 + (np.arange(n) % 97 == 0) * 2.0
        keep = rng.random(n) > (0.05, 0.2, 0.45, 0.01)[i]
        keep[300 : 300 + (0, 2, 5, 200)[i]] = False
        out[i] = [(DAY0 + k * FIVE + int(rng.integers(0, 60)) * 1_000_000, float(v[k])) for k in range(n) if keep[k]]
    return out


@pytest.fixture(scope="module")
def readings(spark, series):
    return spark.createDataFrame([(i, us, v) for i, s in series.items() for us, v in s], "id long, us long, v double").repartition(5)


def grid_of(rows, most):
    """The reference form: resample, first of a bin, gaps of up to `most` bins on a line."""
    s = pd.Series([v for _, v in rows], pd.to_datetime([us for us, _ in rows], unit="us")).resample("5min").first()
    filled, gone = s.interpolate(limit_area="inside"), s.isna().to_numpy()
    start = 0
    while start < len(s):
        end = start
        while end < len(s) and gone[end]:
            end += 1
        if end - start > most:
            filled.iloc[start:end] = np.nan
        start = end + 1
    return filled


def test_grid(readings, series):
    got = nights.resample_first(readings, 5, 3).toPandas()
    for i, rows in series.items():
        want, mine = grid_of(rows, 3), got[got.id == i].sort_values("us")
        assert len(mine) == len(want) and np.allclose(mine.v.to_numpy(float), want.to_numpy(), equal_nan=True, atol=1e-12)
    some = nights.fill_first(readings, 5, 2).toPandas()
    for i, rows in series.items():
        s = pd.Series([v for _, v in rows], pd.to_datetime([us for us, _ in rows], unit="us")).resample("5min").mean()
        assert np.allclose(some[some.id == i].sort_values("us").v.to_numpy(float), s.interpolate(limit=2, limit_area="inside").to_numpy(), equal_nan=True, atol=1e-12)


def window_rows(s):
    out, dates = [], []
    for date in sorted({t.normalize() for t in s.index}):
        night = s[(s.index >= date) & (s.index < date + pd.Timedelta(hours=6))]
        if night.notna().sum() < math.ceil(0.8 * 72):
            continue
        dates.append(date)
        for start in range(0, 271, 15):
            a = date + pd.Timedelta(minutes=start)
            v = night[(night.index >= a) & (night.index < a + pd.Timedelta(minutes=90))].dropna().to_numpy()
            if len(v) >= math.ceil(0.8 * 18):
                mad, d = np.median(np.abs(v - np.median(v))), np.abs(np.diff(v))
                out.append((date, start, np.median(v), mad + np.median(d) + 2 * np.mean(d / 5 > 0.3)))
    return [r for r in out if r[0] in dates[:6]], dates[:6]


def test_windows_and_anchors(readings, series):
    grid = nights.resample_first(readings, 5, 3)
    w = nights.night_windows(grid, 5)
    got = w.toPandas()
    found = {r.id: r for r in nights.anchors(w, grid).collect()}
    for i, rows in series.items():
        s = grid_of(rows, 3)
        want, dates = window_rows(s)
        mine = got[got.id == i].sort_values(["date", "start"])
        assert len(mine) == len(want) and np.allclose(mine["median"], [r[2] for r in want]) and np.allclose(mine.entropy, [r[3] for r in want])
        if not want:
            assert i not in found
            continue
        low = sorted(want, key=lambda r: (r[3], r[0], r[1]))[: max(1, math.ceil(0.01 * len(want)))]
        level = np.median([r[2] for r in low])
        best = [(min((r for r in want if r[0] == d), key=lambda r: (r[3], r[1]))[2], d) for d in dates if any(r[0] == d for r in want)]
        held = np.concatenate([s[(s.index >= d) & (s.index < d + pd.Timedelta(hours=6))].dropna().to_numpy() for _, d in best])
        r = found[i]
        assert math.isclose(r.level, level) and math.isclose(r.dwell, np.mean(np.abs(held - level) <= 0.3)) and r.nights == len(best)
        y = [b for b, _ in best]
        if len(y) >= 4:
            slopes = [(y[b] - y[a]) / (b - a) for a in range(len(y)) for b in range(a + 1, len(y))]
            assert math.isclose(r.drift, np.median(slopes), abs_tol=1e-12) and math.isclose(r.rises, np.mean(np.diff(y) > 0))
        else:
            assert r.drift is None and r.rises is None
    assert any(r.nights >= 4 for r in found.values())


def test_prefix(readings):
    k = nights.eligible_nights(nights.resample_first(readings, 5, 3), 5)
    second = {r.id: r.date for r in k.where("k = 2").collect()}
    got = nights.night_prefix(readings, k, 2).groupBy("id").agg(F.max("us").alias("u"), F.count("*").alias("n")).collect()
    assert {r.id for r in got} == set(second) and all(r.u < (second[r.id] + 1) * 86_400_000_000 for r in got)


def test_ranks_in_two_levels(spark):
    rng = random.Random(2)
    values = [float(rng.choice([1, 2, 2, 2, 7])) for _ in range(300)] + [rng.random() * 1e6 for _ in range(500)] + [None] * 3
    df = spark.createDataFrame(list(enumerate(values)), "k long, x double").repartition(6)
    got = {r.k: r.r for r in windows.ranked(df, "x", "r").collect()}
    want = pd.Series(values).rank()
    assert len(got) == len(values) and all((got[k] is None and math.isnan(want[k])) or got[k] == want[k] for k in got)
    assert windows.ranked(df.limit(0), "x", "r").count() == 0 and windows.cumulated(df.where("x IS NULL"), "x", ["k"]).count() == 0


def test_folds_carry_their_state(spark):
    rng = random.Random(9)
    rows = [(i % 7, rng.randrange(10**6), float(rng.randrange(50)), i % 3) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, at long, v double, seg long").repartition(9)
    kept = {}
    for i, at in sorted((r[0], r[1]) for r in rows):
        if i not in kept or at - kept[i][-1] > 40_000:
            kept.setdefault(i, []).append(at)
    assert sorted((r.id, r.at) for r in windows.merge_events(df, 40_000).collect()) == sorted((i, t) for i, ts in kept.items() for t in ts)
    best = {}
    for i, at, v, _ in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        if all(abs(at - t) >= 30_000 for t, _ in best.setdefault(i, [])):
            best[i].append((at, v))
    assert sorted((r.id, r.at, r.v) for r in windows.suppress(df, 30_000).collect()) == sorted((i, *t) for i, ts in best.items() for t in ts)
    ema = {(r.id, r.seg, r.us): r.v for r in windows.ema(df.withColumn("us", F.col("at")), 0.3).collect()}
    last = {}
    for i, at, v, seg in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        last[i, seg] = v if (i, seg) not in last else 0.3 * v + 0.7 * last[i, seg]
        assert math.isclose(ema[i, seg, at], last[i, seg])


def test_normal_tail(spark):
    z = [0.0, 1e-9, 0.3, 1.0, -1.96, 2.4, 2.999, 3.0, 3.5, 6.0, 12.0, 30.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", stats.normal_tail(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r.p, math.erfc(abs(r.z) / math.sqrt(2)), rel_tol=1e-9, abs_tol=1e-14) for r in got)


def test_shuffles(spark):
    rows = [(i, float(i % 40), int(i % 40 > 30 and i % 3 > 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, x double, y int").repartition(3)
    places = resampling.shuffled(df, "k", 30).collect()
    for rep in range(30):
        assert sorted(r.place for r in places if r.rep == rep) == list(range(1, 401))
    null = [r.value for r in resampling.permuted_separation(df, "k", "x", "y", 60).collect()]
    assert len(null) == 60 and abs(np.mean(null) - 0.5) < 0.03 and 0.01 < np.std(null) < 0.08
    p = {r.column: r for r in resampling.max_statistic(df.withColumn("noise", (F.col("k") * 7919 % 401).cast("double")), "k", ["x", "noise"], "y", 60).collect()}
    assert p["x"].p <= 2 / 61 and p["noise"].p > 0.1


def test_forecast_draws(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(0, 1, 1 + i % 40).tolist(), float(rng.normal())) for i in range(300)] + [(900, [], 1.0), (901, [1.0], None)]
    df = spark.createDataFrame(rows, "k long, d array<double>, y double")
    got = {round(r.level, 2): r for r in nights.quantile_coverage(df, "d", "y").collect()}
    for level in (0.05, 0.5, 0.95):
        want = np.mean([y <= np.quantile(d, level) for _, d, y in rows[:300]])
        assert got[level].n == 300 and math.isclose(got[level].covered, want) and math.isclose(got[level].error, (want - level) ** 2)
    like = {r.k: r.loglik for r in nights.mixture_likelihood(df, "d", "y", 0.01).collect()}
    for k, d, y in rows[:300]:
        t = -0.5 * ((y - np.array(d)) / 0.01) ** 2
        assert math.isclose(like[k], t.max() + math.log(np.exp(t - t.max()).mean()) - math.log(0.01 * math.sqrt(2 * math.pi)), rel_tol=1e-9)
    assert like[900] is None and like[901] is None
