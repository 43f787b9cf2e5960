"""Declared roles of columns, and the datasets' parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"real_valued": "double", "categorical": "string", "date": "timestamp_ntz"}
ROLES = ("target", "observed_input", "known_input", "static_input", "id", "sid", "time")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str
    role: str


@dataclass(frozen=True)
class Dataset:
    """Minutes between grid points, longest gap in a segment, least rows of a segment, and the split's lengths."""

    interval: int
    gap: int
    min_rows: int
    test_share: float
    segment: int
    history: int
    horizon: int


# The datasets' parameters.
DATASETS = {
    "colas": Dataset(5, 45, 192, 0.1, 72, 144, 12),
    "dubosson": Dataset(5, 30, 240, 0.1, 144, 192, 12),
    "hall": Dataset(5, 30, 192, 0.1, 192, 144, 12),
    "iglu": Dataset(5, 45, 240, 0.1, 240, 192, 12),
    "weinstock": Dataset(5, 45, 240, 0.1, 240, 192, 12),
}


def validate(spec: list[ColumnSpec]) -> None:
    """Exactly one id, exactly one time, one target at least; roles and kinds must be known."""
    roles = [c.role for c in spec]
    if roles.count("id") != 1 or roles.count("time") != 1 or "target" not in roles:
        raise ValueError("a spec has one id, one time and at least one target")
    if unknown := [c for c in spec if c.role not in ROLES or c.kind not in KINDS]:
        raise ValueError(f"unknown role or kind: {unknown}")


def conform(df: DataFrame, spec: list[ColumnSpec]) -> DataFrame:
    """Declared columns only, cast to their kinds; rows without id, time or target go."""
    validate(spec)
    df = df.select(*(F.col(f"`{c.name}`").try_cast(KINDS[c.kind]).alias(c.name) for c in spec))
    return df.dropna(subset=[c.name for c in spec if c.role in ("id", "time", "target")])


def assert_complete(df: DataFrame) -> DataFrame:
    """df, or an error that counts the nulls left in each column."""
    nulls = df.select(*(F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns)).first().asDict()
    if bad := {k: n for k, n in nulls.items() if n}:
        raise ValueError(f"nulls left: {bad}")
    return df
