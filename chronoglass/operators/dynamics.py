"""Delay embedding and what is measured in it; kernels with quadratic or sequential state run per id in NumPy."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import by_time


def embed(df: DataFrame, tau: int, dim: int) -> DataFrame:
    """Adds pt: (v, v[+tau], ...), null if a part is null."""
    parts = [F.lead("v", k * tau).over(by_time()) for k in range(dim)]
    return df.withColumn("pt", F.when(~F.exists(F.array(*parts), lambda x: x.isNull()), F.array(*parts)))


def work_length(df: DataFrame, tau: int, norm: float = 480.0) -> DataFrame:
    """Path length in the first two coordinates over neighbouring points, by valid points / norm."""
    e = embed(df, tau, 2)
    d = F.sqrt(F.pow(F.col("pt")[0] - F.lag("pt").over(by_time())[0], F.lit(2)) + F.pow(F.col("pt")[1] - F.lag("pt").over(by_time())[1], F.lit(2)))
    return e.withColumn("d", d).groupBy("id").agg((F.sum("d") / (F.count("pt") / norm)).alias("work"))


def swept_area(df: DataFrame, tau: int) -> DataFrame:
    """|sum of cross products about the median| / 2."""
    e = embed(df, tau, 2).where("pt IS NOT NULL").select("id", "us", F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y"))
    core = e.groupBy("id").agg(F.median("x").alias("cx"), F.median("y").alias("cy"))
    e = e.join(core, "id").select("id", "us", (F.col("x") - F.col("cx")).alias("x"), (F.col("y") - F.col("cy")).alias("y"))
    cross = F.lag("x").over(by_time()) * F.col("y") - F.col("x") * F.lag("y").over(by_time())
    return e.withColumn("c", cross).groupBy("id").agg((F.abs(F.sum("c")) / 2).alias("area"))


def permutation_entropy(df: DataFrame, tau: int = 1) -> DataFrame:
    """Order 3, by ln 6; equal values keep their order."""
    a, b, c = F.col("v"), F.lead("v", tau).over(by_time()), F.lead("v", 2 * tau).over(by_time())
    pattern = F.concat((a <= b).cast("int").cast("string"), (b <= c).cast("int").cast("string"), (a <= c).cast("int").cast("string"))
    n = df.withColumn("p", pattern).where("p IS NOT NULL").groupBy("id", "p").agg(F.count("*").alias("n"))
    total = Window.partitionBy("id")
    return n.withColumn("q", F.col("n") / F.sum("n").over(total)).groupBy("id").agg((-F.sum(F.col("q") * F.log("q")) / math.log(6)).alias("entropy"))


def box_dimension(df: DataFrame, tau: int, grids: tuple = (2, 4, 8, 16)) -> DataFrame:
    """Slope of log boxes on log grid, within [0, 2]."""
    e = embed(df, tau, 2).where("pt IS NOT NULL").select("id", F.col("pt")[0].alias("x"), F.col("pt")[1].alias("y"))
    w = Window.partitionBy("id")
    e = e.select("id", *((F.col(c) - F.min(c).over(w)).alias(c) for c in "xy"), F.greatest(F.max("x").over(w) - F.min("x").over(w), F.max("y").over(w) - F.min("y").over(w)).alias("size")).where("size > 0")
    e = e.select("*", F.explode(F.array(*map(F.lit, grids))).alias("g"))
    box = lambda c: F.least(F.floor(F.col(c) / F.col("size") * F.col("g")), F.col("g") - 1)
    n = e.groupBy("id", "g").agg(F.count_distinct(box("x"), box("y")).alias("n"))
    return n.groupBy("id").agg(F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.regr_slope(F.log("n"), F.log("g")))).alias("dimension"))


def angular_velocity(df: DataFrame) -> DataFrame:
    """2 sum(area) / sum(r^2) of (v - median, central difference), points with r^2 of 0.05 at least, 5 points at least."""
    core = df.groupBy("id").agg(F.median("v").alias("core"))
    x = df.join(core, "id").withColumn("x", F.col("v") - F.col("core")).withColumn("y", (F.lead("v").over(by_time()) - F.lag("v").over(by_time())) / 2)
    x = x.withColumn("dy", F.lead("y").over(by_time()) - F.col("y")).withColumn("dx", F.lead("x").over(by_time()) - F.col("x")).where("y IS NOT NULL AND dy IS NOT NULL")
    x = x.withColumn("r2", F.col("x") * F.col("x") + F.col("y") * F.col("y")).where("r2 >= 0.05")
    s = (F.col("x") * F.col("dy") - F.col("y") * F.col("dx")) / 2
    return x.groupBy("id").agg(F.when(F.count("*") >= 5, 2 * F.sum(s) / F.sum("r2")).alias("omega"))


# Kernels on an id's values in time order, NaN where there is a gap.


def runs_of(v: np.ndarray, least: int) -> list[np.ndarray]:
    ok = np.concatenate([[False], ~np.isnan(v), [False]]).astype(int)
    return [v[a:b] for a, b in zip(np.flatnonzero(np.diff(ok) == 1), np.flatnonzero(np.diff(ok) == -1), strict=True) if b - a >= least]


def tau_of(v: np.ndarray, top: int, least: int) -> int:
    """First lag whose weighted autocorrelation is under 0.3678, or the bottom of a dip under 0.7; else the longest."""
    parts = runs_of(v, least)
    total = sum(map(len, parts))
    r = np.zeros(top + 1)
    for p in parts:
        c, var = p - p.mean(), p.var()
        if var > 0:
            r += len(p) / total * np.array([(c[: len(c) - k] * c[k:]).sum() / ((len(c) - k) * var) if k < len(c) else 0 for k in range(top + 1)])
    for k in range(1, top + 1):
        if r[k] < 0.3678:
            return k
        if k < top and r[k] < 0.7 and r[k] < r[k - 1] and r[k] < r[k + 1]:
            return k
    return top


def points(v: np.ndarray, tau: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(v) - (dim - 1) * tau
    if n < 1:
        return np.zeros((0, dim)), np.zeros(0, int)
    p = np.column_stack([v[k * tau : k * tau + n] for k in range(dim)])
    ok = ~np.isnan(p).any(axis=1)
    return p[ok], np.flatnonzero(ok)


def distances(p: np.ndarray) -> np.ndarray:
    """Between all points, a coordinate at a time."""
    out = np.zeros((len(p), len(p)))
    for x in p.T:
        out += (x[:, None] - x) ** 2
    return np.sqrt(out, out=out)


def effective_dimension(v: np.ndarray, tau: int, dim: int, share: float = 0.99) -> int | None:
    """Leading eigenvalues of the embedded points' covariance that make up `share` of its trace, 2 to dim of them; null
    where the points hardly vary or are fewer than dim."""
    p, _ = points(v, tau, dim)
    if dim < 2 or len(p) < max(2, dim):
        return None
    part = np.sort(np.linalg.eigvalsh(np.cov(p.T)))[::-1]
    if part.sum() < 1e-9:
        return None
    reached = np.cumsum(np.clip(part, 0, None)) >= share * part.sum()
    return int(np.clip(np.argmax(reached) + 1 if reached.any() else dim, 2, dim))


def fnn_dimension(v: np.ndarray, tau: int, top: int = 10, r_tol: float = 15.0, a_tol: float = 2.0) -> int:
    """First dimension with under 5 % false neighbours, or before their share rises."""
    sd, last = np.nanstd(v), None
    for m in range(1, top + 1):
        p, at = points(v, tau, m + 1)
        if len(p) < 3:
            return max(2, m)
        d = distances(p[:, :m])
        np.fill_diagonal(d, np.inf)
        k = d.argmin(axis=1)
        near, extra = d[np.arange(len(p)), k], np.abs(p[:, m] - p[k, m])
        far = np.hypot(near, extra)
        share = float(np.mean((extra > r_tol * np.maximum(near, 1e-12)) | (far > a_tol * sd)))
        if share < 0.05:
            return max(2, m)
        if last is not None and share > last:
            return max(2, m - 1)
        last = share
    return top


def rqa(v: np.ndarray, tau: int, dim: int, share: float = 0.05, theiler: int = 5, line: int = 2) -> dict:
    """Recurrence rate, determinism and entropy of diagonal lines; lines break where points are not neighbours in time."""
    p, at = points(v, tau, dim)
    t = max(theiler, tau)
    n = len(p)
    far = at[None, :] - at[:, None] > t
    if n < 10 or not far.any():
        return {"rr": None, "det": None, "entr": None}
    d = distances(p)
    rec = (d < np.quantile(d[far], share)) & far
    apart, lengths = np.diff(at) != 1, [np.zeros(0, np.int64)]
    for k in range(t + 1, n):
        on = np.flatnonzero(np.diagonal(rec, k))
        if len(on):
            cut = (np.diff(on) != 1) | apart[on[1:] - 1] | apart[on[1:] + k - 1]
            ends = np.concatenate([[0], np.flatnonzero(cut) + 1, [len(on)]])
            lengths.append(np.diff(ends))
    lengths = np.concatenate(lengths)
    if not lengths.sum():
        return {"rr": float(rec.sum() / far.sum()), "det": 0.0, "entr": 0.0}
    long = lengths[lengths >= line]
    q = np.unique(long, return_counts=True)[1] / max(len(long), 1)
    return {"rr": float(rec.sum() / far.sum()), "det": float(long.sum() / lengths.sum()), "entr": float(-(q * np.log(q)).sum())}


def sample_entropy(v: np.ndarray, m: int = 2, r: float = 0.2) -> float | None:
    v = v[~np.isnan(v)]
    if len(v) < m + 2:
        return None
    tol = r * v.std(ddof=1)

    def pairs(k: int) -> int:
        p = np.lib.stride_tricks.sliding_window_view(v, k)
        d = np.zeros((len(p), len(p)))
        for x in p.T:
            np.maximum(d, np.abs(x[:, None] - x), out=d)
        return int((d <= tol).sum() - len(p)) // 2

    a, b = pairs(m + 1), pairs(m)
    return float(-np.log(a / b)) if a and b else None


def simplex(v: np.ndarray, dim: int, tau: int = 1) -> float | None:
    """Correlation of leave-one-out forecasts a step ahead with what came."""
    p, at = points(v[:-1], tau, dim)
    if len(p) < dim + 3:
        return None
    y = v[at + (dim - 1) * tau + 1]
    ok = ~np.isnan(y)
    p, y = p[ok], y[ok]
    if len(p) < dim + 3:
        return None
    d = distances(p)
    np.fill_diagonal(d, np.inf)
    k = np.argsort(d, axis=1, kind="stable")[:, : dim + 1]
    near = np.take_along_axis(d, k, 1)
    w = np.exp(-near / np.maximum(near[:, :1], 1e-12))
    f = (w * y[k]).sum(axis=1) / w.sum(axis=1)
    return float(np.corrcoef(f, y)[0, 1]) if f.std() > 0 and y.std() > 0 else None


def smap_gain(v: np.ndarray, dim: int, thetas: tuple = (0, 0.5, 1, 2, 4, 8)) -> float | None:
    """Best correlation of locally weighted linear forecasts over theta, less that of theta 0."""
    p, at = points(v[:-1], 1, dim)
    if len(p) < 2 * dim + 4:
        return None
    y = v[at + dim]
    ok = ~np.isnan(y)
    p, y = p[ok], y[ok]
    d = distances(p)
    x, rhos = np.column_stack([np.ones(len(p)), p]), []
    for theta in thetas:
        f = np.empty(len(p))
        for i in range(len(p)):
            w = np.exp(-theta * d[i] / max(d[i].mean(), 1e-12))
            w[i] = 0
            f[i] = x[i] @ np.linalg.lstsq(x * w[:, None], y * w, rcond=None)[0]
        rhos.append(np.corrcoef(f, y)[0, 1] if f.std() > 0 and y.std() > 0 else np.nan)
    return float(np.nanmax(rhos) - rhos[0]) if np.isfinite(rhos[0]) else None


def low_pass(v: np.ndarray, wn: float = 0.08, least: int = 12) -> np.ndarray:
    """Second-order Butterworth, forward and backward, on each run of at least 12 values; others as they are."""
    w = math.tan(math.pi * wn / 2)
    q = 1 + math.sqrt(2) * w + w * w
    b, a = np.array([w * w, 2 * w * w, w * w]) / q, np.array([1, 2 * (w * w - 1) / q, (1 - math.sqrt(2) * w + w * w) / q])
    zi = np.array([1 - b[0], b[2] - a[2]])  # the state in which a constant stays as it is

    def once(x: np.ndarray) -> np.ndarray:
        z, out = zi * x[0], np.empty_like(x)
        for i, s in enumerate(x):
            out[i] = b[0] * s + z[0]
            z = np.array([b[1] * s - a[1] * out[i] + z[1], b[2] * s - a[2] * out[i]])
        return out

    out, ok = v.copy(), np.concatenate([[False], ~np.isnan(v), [False]]).astype(int)
    for s, e in zip(np.flatnonzero(np.diff(ok) == 1), np.flatnonzero(np.diff(ok) == -1), strict=True):
        if e - s >= least:
            x, pad = v[s:e], min(9, e - s - 1)
            x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
            out[s:e] = once(once(x)[::-1])[::-1][pad:-pad]
    return out


def surrogate(v: np.ndarray, seed: int) -> np.ndarray:
    """Same spectrum, random phases."""
    f = np.fft.rfft(v)
    phase = np.exp(2j * np.pi * np.random.default_rng(seed).random(len(f)))
    phase[0] = 1
    if len(v) % 2 == 0:
        phase[-1] = 1
    return np.fft.irfft(f * phase, len(v))


def engine(pdf: pd.DataFrame, tau_max: int, least: int) -> pd.DataFrame:
    """The record of one id: delay, dimension, recurrence, entropies, forecast skill; `error` tells why there is none."""
    v = pdf.sort_values("us")["v"].to_numpy(float)
    row = {"id": pdf["id"].iloc[0], "tau": None, "dim": None, "rr": None, "det": None, "entr": None, "sampen": None, "rho": None, "error": None}
    if (~np.isnan(v)).sum() < least:
        row["error"] = "too few points"
    else:
        smooth = low_pass(v)
        row["tau"] = tau_of(v, tau_max, max(8, least // 2))
        row["dim"] = effective_dimension(smooth, row["tau"], fnn_dimension(smooth, row["tau"]))
        if row["dim"] is None:
            row["error"] = "no dimension"
        else:
            row |= rqa(smooth, row["tau"], row["dim"])
            row["rho"] = simplex(v, row["dim"])
        row["sampen"] = sample_entropy(v)
    return pd.DataFrame([row])


def engine_rows(grid: DataFrame, tau_max: int = 12, least: int = 16) -> DataFrame:
    """engine() per id. An id's readings meet in one task: they are one series, and the kernels need all of it."""
    kinds = "id long, tau int, dim int, rr double, det double, entr double, sampen double, rho double, error string"
    return grid.select("id", "us", "v").groupBy("id").applyInPandas(lambda pdf: engine(pdf, tau_max, least).astype({"tau": "Int32", "dim": "Int32"}), kinds)
