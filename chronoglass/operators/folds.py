"""Linear fits that leave a fold or a row out, from sums: no fit reads the rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(xs: list[str], y: str, minus: dict[str, Column] | None = None) -> list[Column]:
    """The sums that a least-squares fit of y on xs and a constant needs, of rows that are complete."""
    minus = minus or {}
    at = lambda c: F.col(c) - minus[c] if c in minus else F.col(c)
    out = [F.count("*").cast("double").alias("s"), *(F.sum(at(c)).alias(f"s_{c}") for c in (*xs, y))]
    return out + [F.sum(at(a) * at(b)).alias(f"s_{a}_{b}") for i, a in enumerate((*xs, y)) for b in (*xs, y)[i:]]


def _names(xs: list[str], y: str) -> list[str]:
    every = [*xs, y]
    return ["s", *(f"s_{c}" for c in every), *(f"s_{a}_{b}" for i, a in enumerate(every) for b in every[i:])]


def _det(m: list[list[Column]]) -> Column:
    """By the first row; for the few columns that a fit has."""
    if len(m) == 1:
        return m[0][0]
    return sum(((-1) ** k * m[0][k] * _det([row[:k] + row[k + 1 :] for row in m[1:]]) for k in range(len(m))), F.lit(0.0))


def slopes(xs: list[str], y: str, tag: str = "") -> dict[str, Column]:
    """Least squares from the sums: `one`, the constant, and a slope for each x, null where the xs are dependent. Sums
    about the mean go in, so large values don't cancel more than they must."""
    col = lambda n: F.col(f"{tag}{n}")
    pair = lambda a, b: col(f"s_{a}_{b}" if [*xs, y].index(a) <= [*xs, y].index(b) else f"s_{b}_{a}") - col(f"s_{a}") * col(f"s_{b}") / F.nullif(col("s"), F.lit(0.0))
    gram = [[pair(a, b) for b in xs] for a in xs]
    det, scale = _det(gram), 1.0
    for k in range(len(xs)):
        scale = scale * gram[k][k]
    out = {}
    for k, c in enumerate(xs):
        changed = [[pair(a, y) if j == k else gram[i][j] for j in range(len(xs))] for i, a in enumerate(xs)]
        out[c] = F.when(F.abs(det) > 1e-12 * F.abs(scale), _det(changed) / F.nullif(det, F.lit(0.0)))
    out["one"] = (col(f"s_{y}") - sum((out[c] * col(f"s_{c}") for c in xs), F.lit(0.0))) / F.nullif(col("s"), F.lit(0.0))
    return out


def out_of_fold_r2(df: DataFrame, fold: str, xs: list[str], y: str, least: int = 50, least_fit: int = 20) -> DataFrame:
    """(r2, n): of y as predicted by least squares on xs in the other folds.

    One pass makes each fold's sums, about the table's means; a fold's fit comes from the total less its own, and its
    squared errors from its own sums and the fit, so rows are read twice however many folds there are. Rows with a null
    are left out. A fold whose other folds have fewer than least_fit rows, or whose fit is not determined, has no part in
    r2; r2 is null under `least` rows in all, under three different y, or under least_fit rows with a prediction."""
    rows = df.dropna(subset=[fold, *xs, y])
    about = rows.agg(*(F.avg(c).alias(c) for c in (*xs, y)), F.count_distinct(y).alias("kinds")).first()
    minus = {c: F.lit(about[c] or 0.0) for c in (*xs, y)}
    own = rows.groupBy(fold).agg(*moments(xs, y, minus))
    names = _names(xs, y)
    total = own.agg(*(F.sum(c).alias(f"t_{c}") for c in names))
    both = own.join(total).select(fold, *names, *((F.col(f"t_{c}") - F.col(c)).alias(f"o_{c}") for c in names))
    fit = both.select("*", *(c.alias(f"b_{n}") for n, c in slopes(xs, y, "o_").items()))
    every = [*xs, y]
    s = lambda a, b: F.col(f"s_{a}_{b}" if every.index(a) <= every.index(b) else f"s_{b}_{a}")
    b, one = {c: F.col(f"b_{c}") for c in xs}, F.col("b_one")
    fitted = sum((b[a] * b[c] * s(a, c) for a in xs for c in xs), F.lit(0.0)) + 2 * one * sum((b[c] * F.col(f"s_{c}") for c in xs), F.lit(0.0)) + one * one * F.col("s")
    cross = sum((b[c] * s(c, y) for c in xs), F.lit(0.0)) + one * F.col(f"s_{y}")
    good = F.when((F.col("o_s") >= least_fit) & one.isNotNull(), 1)
    out = fit.withColumn("error", F.when(good == 1, s(y, y) - 2 * cross + fitted)).agg(
        F.sum("error").alias("e"), F.sum(good * F.col("s")).alias("n"), F.sum(good * F.col(f"s_{y}")).alias("m"), F.sum(good * s(y, y)).alias("mm"), F.sum("s").alias("all")
    )
    spread = F.col("mm") - F.col("m") * F.col("m") / F.nullif("n", F.lit(0.0))
    enough = (F.col("all") >= least) & (F.col("n") >= least_fit) & (spread > 1e-12) & F.lit((about["kinds"] or 0) >= 3)
    return out.select(F.when(enough, 1 - F.col("e") / F.nullif(spread, F.lit(0.0))).alias("r2"), F.coalesce("n", F.lit(0.0)).cast("long").alias("n"))
