"""Phase space, resampling and fits without a fold, against matrices and refits in NumPy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoglass.operators import folds, neighbours, resampling


def signals():
    rng = np.random.default_rng(11)
    t = np.arange(288)
    ar = np.zeros(288)
    for i in range(1, 288):
        ar[i] = 0.9 * ar[i - 1] + rng.normal(0, 0.15)
    return {1: np.full(120, 6.0), 2: 6 + np.sin(2 * np.pi * t / 72), 3: 6 + rng.normal(0, 0.4, 288), 4: np.round(6 + ar, 1), 5: np.where(t < 144, 5.5, 8.5), 6: np.concatenate([6 + rng.normal(0, 1e-3, 200), [50.0, 80.0, -40.0]]), 7: np.array([1.0, 2.0, 4.0])}


@pytest.fixture(scope="module")
def readings(spark):
    rows = [(i, k * 300_000_000, float(v) if not (i == 3 and k in (40, 41, 90)) else None) for i, s in signals().items() for k, v in enumerate(s)]
    return spark.createDataFrame(rows, "id long, us long, v double")


@pytest.fixture(scope="module")
def points(readings):
    return neighbours.embedded(readings, 2, 3)


def by_id(points):
    out = {}
    for r in points.orderBy("id", "idx").collect():
        out.setdefault(r.id, []).append((r.idx, r.pt))
    return {i: (np.array([k for k, _ in v]), np.array([p for _, p in v])) for i, v in out.items()}


def matrix(p):
    d = np.zeros((len(p), len(p)))
    for x in p.T:
        d += (x[:, None] - x) ** 2
    return np.sqrt(d)


@pytest.mark.parametrize(("gap", "least"), [(5, -1.0), (0, 1e-6), (30, -1.0)])
def test_nearest_is_the_matrix_minimum(points, gap, least):
    got = {(r.id, r.i): (r.j, r.d) for r in neighbours.nearest(points, gap, least).collect()}
    want = {}
    for i, (idx, p) in by_id(points).items():
        d = matrix(p)
        d[(np.abs(idx[:, None] - idx) <= gap) | (d <= least)] = np.inf
        for a in range(len(p)):
            if np.isfinite(d[a]).any():
                want[i, idx[a]] = (idx[d[a].argmin()], d[a].min())
    assert got.keys() == want.keys() and len(want) > 600
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], abs_tol=1e-12) for k in want)


def test_divergence(points):
    rates = {r.id: r for r in neighbours.one_step_divergence(points).collect()}
    slopes = {r.id: r.slope for r in neighbours.divergence_slope(points, 5).collect()}
    for i, (idx, p) in by_id(points).items():
        d, has = matrix(p), {k: n for n, k in enumerate(idx)}
        if len(p) >= 30:
            size = (p.max(0) - p.min(0)).max() or 1.0
            zone = [tuple(x) for x in np.floor((p - p.min(0)) / (size / 16)).astype(int)]
            logs = []
            for a, k in enumerate(idx):
                near = [(d[a, b], b) for b, j in enumerate(idx) if zone[a] == zone[b] and abs(k - j) > 5 and j + 1 in has and d[a, b] > 1e-6]
                if k + 1 in has and near:
                    d0, b = min(near)
                    d1 = d[has[k + 1], has[idx[b] + 1]]
                    if d1 > 1e-9:
                        logs.append(math.log(d1 / d0))
            assert rates[i].n == len(logs)
            assert (rates[i].rate is None) if len(logs) < 10 else math.isclose(rates[i].rate, np.mean(logs), rel_tol=1e-9)
        else:
            assert i not in rates
        curves = []
        near = np.where(np.abs(idx[:, None] - idx) <= 5, np.inf, d)
        for a, k in enumerate(idx):
            b = int(near[a].argmin())
            if not np.isfinite(near[a, b]) or near[a, b] <= 1e-9:
                continue
            curve = []
            for h in range(13):
                if k + h not in has or idx[b] + h not in has:
                    break
                curve.append(math.log(max(d[has[k + h], has[idx[b] + h]], 1e-9)))
            if len(curve) >= 4:
                curves.append(curve)
        means = [(h * 5 / 60, np.mean(s)) for h in range(13) if len(s := [c[h] for c in curves if len(c) > h]) >= 20][:7]
        want = np.polyfit(*zip(*means, strict=True), 1)[0] if len(means) >= 4 else None
        assert (slopes.get(i) is None) if want is None else math.isclose(slopes[i], want, rel_tol=1e-6, abs_tol=1e-9)


def runs(on, least=2):
    out, n = [], 0
    for x in [*on, False]:
        if x:
            n += 1
        else:
            out += [n] if n >= least else []
            n = 0
    return out


@pytest.mark.parametrize("sample", [400, 30])
def test_recurrence(points, monkeypatch, sample):
    monkeypatch.setattr(neighbours, "SAMPLE", sample)  # a small sample's guess is too short for some, which try again
    got = {r.id: r for r in neighbours.recurrence(points).collect()}
    for i, (idx, p) in by_id(points).items():
        d, apart = matrix(p), np.abs(idx[:, None] - idx)
        pairs = d[np.triu(apart > 5, 1)]
        if len(pairs) < 50:
            assert i not in got
            continue
        eps = float(np.quantile(pairs, 0.02))
        rec = (d <= eps) & (apart > 5)
        n, count = len(p), int(rec.sum())
        diagonal = [x for o in range(-(n - 1), n) for x in runs(np.diagonal(rec, o))]
        vertical = [x for c in range(n) for x in runs(rec[:, c])]
        q = np.array(list(Counter(diagonal).values())) / max(1, len(diagonal))
        want = {"epsilon": eps, "rr": 100 * count / (apart > 5).sum(), "det": 100 * sum(diagonal) / count, "lam": 100 * sum(vertical) / count, "tt": np.mean(vertical) if vertical else None, "entr": float(-(q * np.log(q)).sum()) if diagonal else None}
        for k, v in want.items():
            assert (got[i][k] is None) if v is None else math.isclose(got[i][k], v, rel_tol=1e-9, abs_tol=1e-9), (i, k, got[i][k], v)
    assert got[2].det > got[3].det


def test_points_of_nothing(spark, points):
    none = points.where("id < 0")
    assert neighbours.nearest(none).count() == 0 and neighbours.recurrence(none).count() == 0
    assert neighbours.one_step_divergence(none).count() == 0 and neighbours.divergence_slope(none, 5).count() == 0


def icc(v):
    n, k = v.shape
    msr = k * ((v.mean(1) - v.mean()) ** 2).sum() / (n - 1)
    msc = n * ((v.mean(0) - v.mean()) ** 2).sum() / (k - 1)
    mse = ((v - v.mean(1)[:, None] - v.mean(0) + v.mean()) ** 2).sum() / ((n - 1) * (k - 1))
    return (msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)


def test_poisson_weights(spark):
    w = spark.range(20_000).select(resampling.poisson_weight(resampling.uniform(F.col("id"), F.lit(3))).alias("w"))
    got = Counter(r.w for r in w.collect())
    for k in range(5):
        assert abs(got[k] / 20_000 - math.exp(-1) / math.factorial(k)) < 0.012
    a, b = (resampling.uniform(F.col("id"), F.lit(r)) for r in (1, 2))
    assert abs(spark.range(5000).select(F.corr(a, b)).first()[0]) < 0.05


def test_bootstrap_against_multinomial(spark):
    rng = np.random.default_rng(5)
    true = rng.normal(0, 1, 150)
    v = np.column_stack([true + rng.normal(0, 0.6, 150), true + 0.1 + rng.normal(0, 0.6, 150)])
    rows = [(i, float(a), float(b), "x") for i, (a, b) in enumerate(v)] + [(900, None, 1.0, "x"), (901, 1.0, None, "y"), (902, 1.0, 2.0, "y")]
    df = spark.createDataFrame(rows, "k long, a double, b double, g string")
    got = {r.g: r for r in resampling.bootstrap_icc(df, "k", "a", "b", ["g"], 300).collect()}
    assert math.isclose(got["x"].icc, icc(v), rel_tol=1e-9) and got["x"].n_pairs == 150 and got["x"].reps == 300
    sample = [icc(v[rng.integers(0, 150, 150)]) for _ in range(2000)]
    assert abs(got["x"].low - np.quantile(sample, 0.025)) < 0.03 and abs(got["x"].high - np.quantile(sample, 0.975)) < 0.03
    assert got["y"].n_pairs == 1 and got["y"].icc is None and got["y"].low is None
    assert resampling.bootstrap_icc(df, "k", "a", "b", [], 20).first().n_pairs == 151


def test_improvement_on_the_same_resample(spark):
    rng = np.random.default_rng(6)
    true = rng.normal(0, 1, 200)
    a, b, c, d = (true + rng.normal(0, s, 200) for s in (0.9, 0.9, 0.3, 0.3))
    df = spark.createDataFrame([(i, *map(float, r), None if i == 3 else 1.0) for i, r in enumerate(zip(a, b, c, d, strict=True))], "k long, a double, b double, c double, d double, e double")
    got = resampling.bootstrap_improvement(df, "k", ("a", "b"), ("c", "d"), 200).first()
    assert math.isclose(got.delta, icc(np.column_stack([c, d])) - icc(np.column_stack([a, b])), rel_tol=1e-9)
    assert 0 < got.low < got.delta < got.high and got.better == 1.0
    same = resampling.bootstrap_improvement(df, "k", ("a", "b"), ("a", "b"), 50).first()
    assert same.low == same.high == 0.0


def test_out_of_fold(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (180, 3)) * [1, 50, 0.01] + [5, 1000, 0]
    y = x @ [1.0, 0.02, 30.0] + rng.normal(0, 1, 180)
    fold = rng.integers(0, 5, 180)
    rows = [(int(f), *map(float, r), float(t)) for f, r, t in zip(fold, x, y, strict=True)] + [(1, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "fold int, a double, b double, c double, y double")
    guess = np.full(180, np.nan)
    for k in range(5):
        m = np.column_stack([np.ones(180), (x - np.median(x[fold != k], axis=0)) / np.subtract(*np.quantile(x[fold != k], [0.75, 0.25], axis=0))])
        guess[fold == k] = m[fold == k] @ np.linalg.lstsq(m[fold != k], y[fold != k], rcond=None)[0]
    got = folds.out_of_fold_r2(df, "fold", ["a", "b", "c"], "y").first()
    assert got.n == 180 and math.isclose(got.r2, 1 - ((y - guess) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel_tol=1e-8)
    assert folds.out_of_fold_r2(df.limit(30), "fold", ["a", "b", "c"], "y").first().r2 is None
    assert folds.out_of_fold_r2(df.withColumn("b", F.col("a") * 2), "fold", ["a", "b"], "y").first() == (None, 0)
    assert folds.out_of_fold_r2(df.limit(0), "fold", ["a"], "y").first() == (None, 0)
