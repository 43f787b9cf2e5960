"""Small models in closed or iterated form, per cohort table; forecasts on lags."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def ridge(x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept first, not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    p = alpha * np.eye(a.shape[1])
    p[0, 0] = 0
    return np.linalg.solve(a.T @ a + p, a.T @ y)


def logistic(x: np.ndarray, y: np.ndarray, alpha: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton steps on the penalised log-likelihood; intercept first, not penalised."""
    a = np.column_stack([np.ones(len(x)), x])
    p = alpha * np.eye(a.shape[1])
    p[0, 0] = 1e-9
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        m = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        step = np.linalg.solve((a * (m * (1 - m))[:, None]).T @ a + p, a.T @ (y - m) - p @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-10:
            break
    return beta


def nonnegative_ridge(x: np.ndarray, y: np.ndarray, alpha: float, rounds: int = 5000) -> np.ndarray:
    """Weights at least zero that minimise |y - x w|^2 + alpha |w|^2; x and y centred. Projected gradient steps with
    momentum on the normal equations, whose size does not depend on the rows."""
    gram, target = x.T @ x + alpha * np.eye(x.shape[1]), x.T @ y
    step = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-300)
    w = ahead = np.zeros(x.shape[1])
    for k in range(rounds):
        new = np.clip(ahead - step * (gram @ ahead - target), 0, None)
        forward = k / (k + 3) if (new - w) @ (ahead - new) <= 0 else 0.0
        w, ahead, moved = new, new + forward * (new - w), np.abs(new - w).max(initial=0)
        if moved < 1e-12:
            break
    return w


def lag_forecast(samples: DataFrame, past: int, future: int, fold: str, alpha: float = 1e-6) -> DataFrame:
    """(id, us, k, forecast, actual) of rows whose fold column is not 0, by linear regression on the past, fitted on fold 0.

    Normal equations are summed over all rows by the tasks: what reaches the driver is (past + 1) x (past + 1 + future).
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    def sums(batches):
        a = np.zeros((past + 1, past + 1 + future))
        for b in batches:
            if b.num_rows:
                x = np.column_stack([np.ones(b.num_rows), np.array(b["past"].to_pylist())])
                a += x.T @ np.column_stack([x, np.array(b["future"].to_pylist())])
        yield pa.RecordBatch.from_pydict({"a": [a.ravel().tolist()]})

    parts = samples.where(F.col(fold) == 0).select("past", "future").mapInArrow(sums, "a array<double>")
    total = parts.select(F.posexplode("a").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).orderBy("i").toPandas()["x"].to_numpy().reshape(past + 1, -1)
    beta = np.linalg.solve(total[:, : past + 1] + alpha * np.eye(past + 1), total[:, past + 1 :])

    def apply(batches):
        for pdf in batches:
            if len(pdf):
                f = np.column_stack([np.ones(len(pdf)), np.array(pdf["past"].tolist())]) @ beta
                n = len(pdf)
                yield pd.DataFrame({"id": np.repeat(pdf["id"], future), "us": np.repeat(pdf["us"], future), "k": np.tile(np.arange(future), n), "forecast": f.ravel(), "actual": np.array(pdf["future"].tolist()).ravel()})

    return samples.where(F.col(fold) != 0).select("id", "us", "past", "future").mapInPandas(apply, "id long, us long, k int, forecast double, actual double")


def errors(forecasts: DataFrame) -> DataFrame:
    """Mean and median of per-forecast squared and absolute error, and the Gaussian log-likelihood of the mean one."""
    from pyspark.sql import functions as F

    d = F.col("forecast") - F.col("actual")
    one = forecasts.groupBy("id", "us").agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("t"))
    out = one.agg(F.avg("mse").alias("mse"), F.median("mse").alias("mse_median"), F.avg("mae").alias("mae"), F.median("mae").alias("mae_median"), F.max("t").alias("t"))
    return out.withColumn("loglik", -0.5 * F.col("t") - 0.5 * F.log(2 * np.pi * F.col("mse")))
